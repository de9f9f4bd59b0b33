"""The same results in plain SQL, for checking `catalog.QUERIES`."""

from __future__ import annotations

from logwarden.functions.net import IP_PATTERN, PORT_PATTERN
from logwarden.plans.demo import AS_OF, GAP_START, GROUPS
from logwarden.rulesets import GROUPS as RULE_GROUPS

TOP = 4294967295


def ip_sql(user: str, clean: bool) -> str:
    high, low = f"(({user} + 1) // 65536)", f"(({user} + 1) % 65536)"
    if clean:
        v6 = f"'2001:db8::' || CASE WHEN {high} > 0 THEN printf('%x:', {high}) ELSE '' END || printf('%x', {low})"
    else:
        v6 = f"'2001:0DB8:0:0:0:0:' || printf('%X', {high}) || ':' || printf('%X', {low})"
    v4 = f"'10.' || ({user} // 62500) || '.' || ({user} // 250 % 250) || '.' || ({user} % 250 + 1)"
    return f"(CASE WHEN {user} % 5 = 0 THEN {v6} ELSE {v4} END)"


EV = f"""ev AS (
  SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type,
    {ip_sql('user_id', False)} AS raw, {ip_sql('user_id', True)} AS ip FROM events)"""

LINES = f"""{EV}, log_lines AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'ApacheAccess' ELSE 'OpenSSH' END AS log_group,
    CASE event_type
      WHEN 'error' THEN 'Jun  2 11:25:00 somehost sshd[' || seq || ']: Invalid user u' || user_id || ' from ' || raw
        || ' port ' || (seq % 60000 + 1024)
      WHEN 'signup' THEN 'Jun  2 11:25:00 somehost sshd[' || seq || ']: ROOT LOGIN REFUSED FROM ' || raw
      WHEN 'purchase' THEN 'Aug  3 04:04:33 somehost kernel: [1.2] IPTABLES-DROPPED: IN=e SRC=' || raw
        || ' DST=10.9.9.9 DPT=' || (['22', '80', '443', '8090'])[seq % 4 + 1] || ' LEN=1'
      ELSE raw || ' - - [17/Jun/2016:07:07:07 +0000] "GET '
        || CASE WHEN event_type = 'click' THEN '/phpMyAdmin/' ELSE '/index.html' END || ' HTTP/1.1" 404 1' END AS line
  FROM ev)"""

# What each event type comes down to under the built-in rules; `match_*` checks this
# against the rules themselves.
HITS = f"""{LINES}, hits AS (
  SELECT seq, ts, ip, user_id, log_group, line,
    event_type, CASE WHEN event_type = 'purchase' THEN 'refused' ELSE 'activity' END AS kind,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 3 WHEN 'click' THEN 2
      ELSE ([0, 2, 5, 10])[seq % 4 + 1] END AS rule_idx,
    CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 20 WHEN 'click' THEN 2 ELSE 5 END AS score,
    CASE WHEN event_type = 'error' THEN seq % 60000 + 1024 WHEN event_type = 'purchase' AND seq % 4 = 3 THEN 8090 END AS port
  FROM log_lines WHERE event_type <> 'view')"""

# Three rules, each of them for one event type.
NUMBERED_RULES = f"""WITH {HITS} SELECT seq, CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS INTEGER) AS rule_idx,
    CAST(CASE event_type WHEN 'signup' THEN 7 WHEN 'error' THEN 8 ELSE 9 END AS BIGINT) AS score, ip,
    CASE WHEN event_type = 'error' THEN CAST(port AS INTEGER) END AS port
    FROM hits WHERE event_type IN ('signup', 'error', 'click')"""

KNOWN = f"""{HITS}, counted AS (
  SELECT * FROM hits h WHERE kind = 'activity' OR EXISTS (
    SELECT 1 FROM hits a WHERE a.ip = h.ip AND a.kind = 'activity' AND (a.ts, a.seq) <= (h.ts, h.seq)))"""

KEPT = f"""kept AS (
  SELECT {ip_sql('user_id', True)} AS ip, CAST({GAP_START} AS BIGINT) AS last_activity, user_id * 7919 % 200000 AS score,
    user_id % 50 AS activity_count, user_id % 7 AS refused_count, user_id % 34 = 0 AS whitelisted,
    user_id % 38 = 0 AND user_id % 34 <> 0 AS blacklisted,
    CAST(CASE WHEN user_id % 3 = 0 THEN {GAP_START} + user_id ELSE 0 END AS BIGINT) AS last_reported,
    CASE WHEN user_id % 5 = 0 THEN 6 ELSE 4 END AS ip_version, user_id % 4 = 0 AS has_rule
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0)"""


def feed_sql(old: bool) -> str:
    return f"""SELECT {ip_sql('(c_custkey * 3)', True)} AS ip, c_custkey % 1000 + {0 if old else 1} AS total_reports,
    CAST(25 + c_custkey % 76 AS INTEGER) AS confidence, CASE WHEN c_custkey * 3 % 5 = 0 THEN 6 ELSE 4 END AS ip_version,
    {'c_custkey % 7 = 0' if old else 'false'} AS has_rule
  FROM customer WHERE c_custkey % {3 if old else 4} <> 0"""


FEEDS = f"old_feed AS ({feed_sql(True)}), new_feed AS ({feed_sql(False)})"

LISTING = f"""listing AS (
  SELECT CASE WHEN user_id % 5 = 0 THEN 6 ELSE 4 END AS ip_version, {ip_sql('user_id', True)} AS ip,
    '-A INPUT -s ' || {ip_sql('user_id', True)} || CASE WHEN user_id % 5 = 0 THEN '/128' ELSE '/32' END
      || CASE WHEN user_id % 7 = 0 THEN ' -j ACCEPT' ELSE ' -j DROP' END AS line
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0
  UNION ALL
  SELECT 4, '192.0.2.' || (s_suppkey % 250 + 1), '-A INPUT -s 192.0.2.' || (s_suppkey % 250 + 1) || '/32 -j DROP'
  FROM supplier),
  parsed AS (SELECT * FROM listing WHERE line LIKE '% -j DROP%')"""


def match_sql(kind: str) -> str:
    """Every rule of the built-in groups, tried in order on every line."""

    def regex(pattern: str) -> str:
        pattern = pattern.replace("%p", PORT_PATTERN, 1).replace("%i", f"({IP_PATTERN})", 1)
        return pattern.replace("'", "''")

    choose, score, port = [], [], []
    for group in GROUPS:
        rules = [r for r in RULE_GROUPS[group] if r[0] == kind]
        for n, (_, pattern, points, _, _) in enumerate(rules):
            choose.append(
                f"WHEN log_group = '{group}' AND regexp_full_match(line, '{regex(pattern)}', 'i') THEN {n}"
            )
            here = f"WHEN log_group = '{group}' AND rule_idx = {n}"
            score.append(f"{here} THEN {points}")
            if "%p" in pattern:
                port.append(f"{here} THEN CAST(regexp_extract(line, '{regex(pattern)}', 2, 'i') AS INTEGER)")
    ports = f"CASE {' '.join(port)} END" if port else "CAST(NULL AS INTEGER)"
    return f"""WITH {LINES}, chosen AS (SELECT *, CASE {' '.join(choose)} END AS rule_idx FROM log_lines)
  SELECT seq, ts, log_group, '{kind}' AS kind, rule_idx, CAST(CASE {' '.join(score)} END AS BIGINT) AS score, ip,
    CASE WHEN user_id % 5 = 0 THEN 6 ELSE 4 END AS ip_version, {ports} AS port, line
  FROM chosen WHERE rule_idx IS NOT NULL"""


def fold_sql(source: str, multiplier: int) -> str:
    """Scores hit by hit, each from the one before (recursive, no closed form)."""
    add = f"least(n.score * {max(multiplier, 1)}, {TOP})"
    left = "greatest(0, f.s - (n.ts - f.ts))" if multiplier else "f.s"
    first = f"least(score * {max(multiplier, 1)}, {TOP})"
    return f"""ordered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS rn FROM {source}),
  fold AS (
    SELECT ip, rn, ts, seq, kind, score, CAST({first} AS BIGINT) AS s FROM ordered WHERE rn = 1
    UNION ALL
    SELECT n.ip, n.rn, n.ts, n.seq, n.kind, n.score, CAST(least({left} + {add}, {TOP}) AS BIGINT)
    FROM fold f JOIN ordered n ON n.ip = f.ip AND n.rn = f.rn + 1)"""


def scored_sql(multiplier: int = 3600) -> str:
    return f"WITH RECURSIVE {KNOWN}, {fold_sql('counted', multiplier)}"


STATE = f"""{scored_sql()}, final AS (
  SELECT ip, max(ts) AS last_activity, max_by(s, rn) AS score, count(*) FILTER (kind = 'activity') AS activity_count,
    count(*) FILTER (kind = 'refused') AS refused_count FROM fold GROUP BY ip),
  state AS (SELECT *, last_activity % 17 = 0 AS whitelisted, last_activity % 17 = 1 AS blacklisted FROM final)"""

OVER = f"{AS_OF} < last_activity + score - 36000"
OVER_AT_END = "score > 0 AND (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events) < last_activity + score - 36000"
STATUS = f"""CASE WHEN whitelisted THEN 'whitelisted' WHEN blacklisted THEN 'blacklisted'
  WHEN {OVER} THEN strftime(make_timestamp((last_activity + score) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END"""
VERSION = "CASE WHEN contains(ip, ':') THEN 6 ELSE 4 END"


def update_sql() -> str:
    """Stored rows take part as a first hit of their own; late hits move up to them."""
    return f"""WITH RECURSIVE {HITS}, {KEPT}, counted AS (
    SELECT * FROM hits h WHERE kind = 'activity' OR ip IN (SELECT ip FROM kept) OR EXISTS (
      SELECT 1 FROM hits a WHERE a.ip = h.ip AND a.kind = 'activity' AND (a.ts, a.seq) <= (h.ts, h.seq))),
  moved AS (
    SELECT ip, CAST(-1 AS BIGINT) AS seq, last_activity AS ts, last_activity AS told, score AS added, 0 AS act, 0 AS ref
    FROM kept WHERE ip IN (SELECT ip FROM counted)
    UNION ALL
    SELECT c.ip, c.seq, greatest(c.ts, coalesce(k.last_activity, c.ts)), c.ts, c.score * 3600,
      CASE WHEN kind = 'activity' THEN 1 ELSE 0 END, CASE WHEN kind = 'refused' THEN 1 ELSE 0 END
    FROM counted c LEFT JOIN kept k ON k.ip = c.ip),
  ordered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY ip ORDER BY seq >= 0, ts, told, seq) AS rn FROM moved),
  fold AS (
    SELECT ip, rn, ts, CAST(added AS BIGINT) AS s FROM ordered WHERE rn = 1
    UNION ALL
    SELECT n.ip, n.rn, n.ts, CAST(least(greatest(0, f.s - (n.ts - f.ts)) + n.added, {TOP}) AS BIGINT)
    FROM fold f JOIN ordered n ON n.ip = f.ip AND n.rn = f.rn + 1),
  ends AS (SELECT ip, max(ts) AS la, max_by(s, rn) AS s FROM fold GROUP BY ip),
  counts AS (SELECT ip, CAST(sum(act) AS BIGINT) AS act, CAST(sum(ref) AS BIGINT) AS ref FROM moved GROUP BY ip)
  SELECT coalesce(e.ip, k.ip) AS ip, coalesce(e.la, k.last_activity) AS last_activity, coalesce(e.s, k.score) AS score,
    coalesce(k.activity_count, 0) + coalesce(c.act, 0) AS activity_count,
    coalesce(k.refused_count, 0) + coalesce(c.ref, 0) AS refused_count,
    coalesce(whitelisted, false) AS whitelisted, coalesce(blacklisted, false) AS blacklisted,
    coalesce(last_reported, 0) AS last_reported, CASE WHEN contains(coalesce(e.ip, k.ip), ':') THEN 6 ELSE 4 END AS ip_version,
    coalesce(has_rule, false) AS has_rule
  FROM ends e FULL JOIN kept k ON k.ip = e.ip LEFT JOIN counts c ON c.ip = e.ip"""


def plan_sql(wanted: str, expired: str, tool_add: str, has_rule: str) -> str:
    return f"""WITH {KEPT}, {FEEDS}, {LISTING},
  everyone AS (SELECT ip FROM kept UNION SELECT ip FROM new_feed UNION SELECT ip FROM parsed),
  facts AS (
    SELECT e.ip, k.ip IS NOT NULL AS in_state, f.ip IS NOT NULL AS in_feed, coalesce(f.confidence, 0) AS confidence,
      coalesce(k.whitelisted, false) AS wl, coalesce(k.blacklisted, false) AS bl, k.last_activity, k.score,
      {has_rule} AS has_rule, CASE WHEN contains(e.ip, ':') THEN 6 ELSE 4 END AS ip_version
    FROM everyone e LEFT JOIN kept k ON k.ip = e.ip LEFT JOIN new_feed f ON f.ip = e.ip),
  acts AS (
    SELECT *, CASE WHEN NOT in_state AND NOT in_feed THEN 'UNKNOWN'
      WHEN has_rule AND in_state AND (wl OR (NOT bl AND NOT in_feed AND ({expired}))) THEN 'REMOVE'
      WHEN has_rule THEN 'KEEP'
      WHEN NOT wl AND (bl OR (in_feed AND confidence >= 90) OR (in_state AND ({wanted}))) THEN 'ADD' END AS action
    FROM facts)
  SELECT ip, ip_version, action,
    CASE action WHEN 'ADD' THEN {tool_add} || ip || ' -j DROP'
      WHEN 'REMOVE' THEN CASE ip_version WHEN 6 THEN 'ip6tables' ELSE 'iptables' END || ' -D INPUT -s ' || ip || ' -j DROP'
    END AS command
  FROM acts WHERE action IS NOT NULL"""


TOOL = "CASE ip_version WHEN 6 THEN 'ip6tables' ELSE 'iptables' END"
PLAN_TIME = GAP_START + 100000
PLAN = plan_sql(
    f"score > 0 AND last_activity + score > 36000 AND {PLAN_TIME} < last_activity + score - 36000",
    f"{PLAN_TIME} > last_activity + score",
    f"{TOOL} || ' -I INPUT 1 -s '",
    "e.ip IN (SELECT ip FROM parsed)",
)
PLAN_NO_DECAY = plan_sql(
    "score > 100000", "score = 0", f"{TOOL} || ' -A INPUT -s '",
    "(e.ip IN (SELECT ip FROM parsed) OR coalesce(k.has_rule, false))",
)

DIFF = f"""WITH {FEEDS}, diff AS (
  SELECT coalesce(o.ip, n.ip) AS ip,
    CASE WHEN o.ip IS NULL THEN 'new' WHEN n.ip IS NULL THEN 'removed' ELSE 'updated' END AS action,
    n.total_reports, n.confidence, CASE WHEN contains(coalesce(o.ip, n.ip), ':') THEN 6 ELSE 4 END AS ip_version,
    coalesce(o.has_rule, false) AS has_rule
  FROM old_feed o FULL JOIN new_feed n ON n.ip = o.ip)"""

CANDIDATES = f"""{KNOWN}, {KEPT}, candidates AS (
  SELECT *, CASE WHEN log_group = 'OpenSSH' THEN '18,22' ELSE '15,21' END AS categories,
    CASE WHEN log_group = 'OpenSSH' THEN '%d %i port %p: %m' ELSE '%i asked for it at %d' END AS comment
  FROM counted WHERE ip NOT IN (SELECT ip FROM kept WHERE whitelisted))"""


def chosen_sql(gap: int = 86400) -> str:
    """Reports one by one: the next is the first candidate late enough after the last."""
    return f"""WITH RECURSIVE {CANDIDATES},
  firsts AS MATERIALIZED (SELECT ip, ts, min(seq) AS seq FROM candidates GROUP BY ip, ts),
  starts AS (SELECT f.ip, min(f.ts) AS ts FROM firsts f LEFT JOIN kept k ON k.ip = f.ip
    WHERE f.ts >= coalesce(k.last_reported, 0) + {gap} GROUP BY f.ip),
  picked AS (
    SELECT ip, ts FROM starts
    UNION ALL
    SELECT p.ip, (SELECT min(f.ts) FROM firsts f WHERE f.ip = p.ip AND f.ts >= p.ts + {gap}) FROM picked p
    WHERE EXISTS (SELECT 1 FROM firsts f WHERE f.ip = p.ip AND f.ts >= p.ts + {gap})),
  emitted AS (SELECT c.* FROM picked p JOIN firsts f ON f.ip = p.ip AND f.ts = p.ts JOIN candidates c ON c.seq = f.seq)"""


def url_sql(text: str) -> str:
    return f"url_encode({text})"


# Fixed values, written out here a second time so that a slip on either side shows.
CATEGORY_VALUES = """(3, 'FraudOrders'), (4, 'DDoSAttach'), (5, 'FTPBruteForce'), (6, 'PingOfDeath'), (7, 'Phishing'),
    (8, 'FraudVoIP'), (9, 'OpenProxy'), (10, 'WebSpam'), (11, 'EmailSpam'), (12, 'BlogSpam'), (13, 'VPNIP'), (14, 'PortScan'),
    (15, 'Hacking'), (16, 'SQLInjection'), (17, 'Spoofing'), (18, 'BruteForce'), (19, 'BadWebBot'), (20, 'ExploitedHost'),
    (21, 'WebAppAttack'), (22, 'SSH'), (23, 'IoTTargeted')"""
STRICT_V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"

STATE_LINES = f"""lines AS (
  SELECT 'd' AS kind, event_id AS seq, {ip_sql('user_id', True)} AS ip, event_id * 100 AS last_activity, event_id % 77 AS score,
    event_id % 55 AS activity_count, event_id % 33 AS refused_count, user_id % 3 = 0 AS whitelisted,
    user_id % 2 = 0 AND user_id % 3 <> 0 AS blacklisted,
    CASE WHEN event_id % 3 = 0 THEN event_id * 5 ELSE 0 END AS last_reported,
    CASE WHEN user_id % 5 = 0 THEN 6 ELSE 4 END AS ip_version FROM events)"""

CONFIG = """sup AS (
  SELECT s_suppkey AS k, replace(s_name, '#', '-') AS log_group, CAST(s_nationkey AS VARCHAR) AS config,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS group_idx FROM supplier),
  rules AS (
    SELECT config, log_group, 'activity' AS kind, 0 AS rule_idx, '^' || log_group || ' from %i port %p' AS pattern, k % 30 AS score,
      true AS report, '' AS categories, CAST(NULL AS VARCHAR) AS comment FROM sup
    UNION ALL
    SELECT config, log_group, 'refused', 0, log_group || ' %p SRC=%i', CASE WHEN k % 2 = 0 THEN 5 ELSE 1 END, NULL, '', '%m' FROM sup
    UNION ALL
    SELECT config, log_group, 'activity', 1, 'plain %i', 1, NULL, '', NULL FROM sup)"""


def toggle_sql(flag: str, other: str) -> str:
    """Commands one after another, by recursion over their order."""
    return f"""WITH RECURSIVE {EV}, {KEPT}, cmds AS MATERIALIZED (
    SELECT ip, seq % 3 = 0 AS ok, row_number() OVER (PARTITION BY ip ORDER BY seq) AS rn FROM ev),
  everyone AS (
    SELECT ip, last_activity, {flag} AS f, {other} AS o FROM kept
    UNION ALL SELECT DISTINCT ip, CAST({AS_OF} AS BIGINT), false, false FROM cmds WHERE ip NOT IN (SELECT ip FROM kept)),
  steps AS (
    SELECT ip, last_activity, f, o, CAST(0 AS BIGINT) AS rn FROM everyone
    UNION ALL
    SELECT s.ip, s.last_activity, CASE WHEN s.o THEN s.f OR c.ok ELSE NOT s.f END, s.o AND NOT c.ok, c.rn
    FROM steps s JOIN cmds c ON c.ip = s.ip AND c.rn = s.rn + 1)
  SELECT ip, last_activity, max_by(f, rn) AS {flag}, max_by(o, rn) AS {other} FROM steps GROUP BY ip, last_activity"""


MARKS = "marks AS (SELECT '/var/log/' || p_partkey AS path, p_partkey * 10 AS bookmark, p_partkey * 11 AS size FROM part WHERE p_partkey % 3 <> 0)"
FILES = "files AS (SELECT '/var/log/' || p_partkey AS path, p_partkey * 9 + p_partkey % 5 * 1000 AS length FROM part WHERE p_partkey % 4 <> 0)"

V6_TEXT = r"\A2001:0[dD][bB]8:0:0:0:0:[0-9A-F]{1,4}:[0-9A-F]{1,4}\z"


def render_sql(template: str, ip: str, port: str, line: str, now: str) -> str:
    """First placeholder of each kind, one after the other."""
    text = template
    for token, value in (("%i", ip), ("%p", port), ("%m", line), ("%d", now)):
        at = f"instr({text}, '{token}')"
        filled = f"left({text}, {at} - 1) || {value} || substr({text}, {at} + 2)"
        text = f"(CASE WHEN {at} > 0 AND {value} IS NOT NULL THEN {filled} ELSE {text} END)"
    return text


def _rendered() -> str:
    """Step by step in subqueries, which keeps the text short."""
    steps = chosen_sql() + ", r0 AS (SELECT ip, ts, port, line, categories, comment AS c, "
    steps += "strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS now FROM emitted)"
    values = (("%i", "ip"), ("%p", "CAST(port AS VARCHAR)"), ("%m", "line"), ("%d", "now"))
    for n, (token, value) in enumerate(values):
        steps += f""", r{n + 1} AS (SELECT * EXCLUDE (c), CASE WHEN instr(c, '{token}') > 0 AND {value} IS NOT NULL
          THEN left(c, instr(c, '{token}') - 1) || {value} || substr(c, instr(c, '{token}') + 2) ELSE c END AS c FROM r{n})"""
    return steps


RENDERED = f"""{_rendered()}, done AS (
  SELECT ip, ts, categories, replace(replace(left(c, 1500), 'somehost', '********'), '10.9.9.9', '********') AS comment FROM r4)
  SELECT ip, ts, comment, 'categories=' || categories || '&comment=' || {url_sql('comment')} || '&ip=' || ip AS payload FROM done"""

RENDERED_PLAIN = f"{_rendered()} SELECT ip, ts, left(c, 1500) AS comment FROM r4"

DOC_RENDERED = r"""WITH r0 AS (
    SELECT doc_id, text, '10.0.0.' || (doc_id % 250) AS ip, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS port,
      strftime(make_timestamp(doc_id * 86461 * 1000000), '%Y/%m/%d %H:%M') AS now, '%i:%p %m | %d %i ' || source AS c FROM documents),
  r1 AS (SELECT * EXCLUDE (c), left(c, instr(c, '%i') - 1) || ip || substr(c, instr(c, '%i') + 2) AS c FROM r0),
  r2 AS (SELECT * EXCLUDE (c), CASE WHEN port IS NULL THEN c ELSE left(c, instr(c, '%p') - 1) || port || substr(c, instr(c, '%p') + 2) END AS c FROM r1),
  r3 AS (SELECT * EXCLUDE (c), left(c, instr(c, '%m') - 1) || text || substr(c, instr(c, '%m') + 2) AS c FROM r2),
  r4 AS (SELECT * EXCLUDE (c), left(c, instr(c, '%d') - 1) || now || substr(c, instr(c, '%d') + 2) AS c FROM r3)
  SELECT doc_id, left(c, 1500) AS comment, CAST(length(c) AS INTEGER) AS full_length FROM r4"""

EPISODES = f"""{scored_sql()}, flagged AS (
    SELECT ip, rn, ts, s, CASE WHEN lag(ts + s) OVER w IS NULL OR ts > lag(ts + s) OVER w THEN 1 ELSE 0 END AS starts
    FROM fold WINDOW w AS (PARTITION BY ip ORDER BY rn)),
  runs AS (SELECT *, sum(starts) OVER (PARTITION BY ip ORDER BY rn) AS run FROM flagged)
  SELECT ip, min(ts) FILTER (s > 36000) AS blocked_from, max(ts + s) AS blocked_until FROM runs GROUP BY ip, run
  HAVING min(ts) FILTER (s > 36000) IS NOT NULL"""

ORACLE = {
    "match_escapes": NUMBERED_RULES,
    "match_posix": NUMBERED_RULES,
    "match_long_list": f"""WITH {EV}, keyed AS (SELECT *, CASE WHEN user_id >= 10 THEN user_id // 10 ELSE user_id END AS k FROM ev)
        SELECT seq, CAST(k + CASE WHEN k < 500 THEN 0 WHEN k < 699 THEN 1 ELSE 2 END AS INTEGER) AS rule_idx,
          CAST(k % 50 + 1 AS BIGINT) AS score, ip, CAST(seq % 60000 + 1024 AS INTEGER) AS port
        FROM keyed WHERE event_type = 'error' AND k < 1000
        UNION ALL SELECT seq, 500, 60, ip, NULL FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT seq, 700, 61, ip, NULL FROM ev WHERE event_type = 'purchase'""",
    "rule_problems": """SELECT CAST(s_suppkey AS INTEGER) AS rule_idx, s_suppkey % 6 = 4 AS no_place
        FROM supplier WHERE s_suppkey % 6 IN (1, 3, 4, 5)""",
    "repeated_groups": f"""WITH {HITS} SELECT seq, CAST(CASE WHEN event_type = 'click' THEN 1 ELSE seq % 2 * 2 END AS INTEGER) AS group_idx,
        CAST(CASE WHEN event_type = 'click' THEN 4 WHEN seq % 2 = 0 THEN 3 ELSE 5 END AS BIGINT) AS score, ip,
        CASE WHEN event_type = 'click' THEN '21' WHEN seq % 2 = 0 THEN '18' ELSE '22,15' END AS categories
        FROM hits WHERE event_type IN ('error', 'click')""",
    "match_first_rule": match_sql("activity"),
    "match_refused": match_sql("refused"),
    "known_refused": f"""WITH {HITS}, {KEPT}, {FEEDS}
      SELECT seq, ts, ip, rule_idx, CAST(score AS BIGINT) AS score FROM hits h WHERE kind = 'refused' AND (
        ip IN (SELECT ip FROM kept) OR ip IN (SELECT ip FROM old_feed) OR EXISTS (
          SELECT 1 FROM hits a WHERE a.ip = h.ip AND a.kind = 'activity' AND (a.ts, a.seq) <= (h.ts, h.seq)))""",
    "unknown_refused": f"""WITH {HITS} SELECT seq, ts, ip FROM hits h WHERE kind = 'refused' AND NOT EXISTS (
        SELECT 1 FROM hits a WHERE a.ip = h.ip AND a.kind = 'activity' AND (a.ts, a.seq) <= (h.ts, h.seq))""",
    "attach_state": f"""WITH {HITS}, {KEPT} SELECT seq, kind, ip, CAST(h.score AS BIGINT) AS score, last_activity, activity_count,
        whitelisted, has_rule FROM hits h LEFT JOIN kept USING (ip)""",
    "decayed_score": f"{scored_sql()} SELECT ip, ts, seq, kind, CAST(score AS BIGINT) AS score, s AS running_score FROM fold",
    "growing_score": f"{scored_sql(0)} SELECT ip, ts, seq, s AS running_score FROM fold",
    "state_after": f"""{STATE} SELECT ip, last_activity, score, activity_count, refused_count, false AS whitelisted,
        false AS blacklisted, CAST(0 AS BIGINT) AS last_reported, {VERSION} AS ip_version, false AS has_rule FROM state""",
    "state_update": update_sql(),
    "activity_by_address": f"""WITH {HITS} SELECT ip, count(*) FILTER (kind = 'activity') AS activity_count,
        count(*) FILTER (kind = 'refused') AS refused_count, max(ts) AS last_activity FROM hits GROUP BY ip""",
    "expiry": f"{STATE} SELECT ip, last_activity + score AS expires_at FROM state",
    "saturated_state": f"""WITH RECURSIVE {HITS}, {KEPT}, moved AS (
        SELECT ip, CAST(-1 AS BIGINT) AS seq, last_activity AS ts, CAST({TOP} AS BIGINT) AS added FROM kept
        UNION ALL SELECT h.ip, h.seq, greatest(h.ts, {GAP_START}), CAST(h.score * 3600 AS BIGINT) FROM hits h JOIN kept USING (ip)
        UNION ALL SELECT ip, seq, ts, CAST(score * 3600 AS BIGINT) FROM hits WHERE ip NOT IN (SELECT ip FROM kept)),
      ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS rn FROM moved),
      fold AS (SELECT ip, rn, ts, added AS s FROM ordered WHERE rn = 1
        UNION ALL SELECT n.ip, n.rn, n.ts, CAST(least(greatest(0, f.s - (n.ts - f.ts)) + n.added, {TOP}) AS BIGINT)
        FROM fold f JOIN ordered n ON n.ip = f.ip AND n.rn = f.rn + 1),
      ends AS (SELECT ip, max(ts) AS last_activity, max_by(s, rn) AS score FROM fold GROUP BY ip),
      counts AS (SELECT ip, count(*) FILTER (kind = 'activity') AS a, count(*) FILTER (kind = 'refused') AS r FROM hits GROUP BY ip)
      SELECT ip, last_activity, score,
        CAST(CASE WHEN ip IN (SELECT ip FROM kept) THEN least({TOP}, {TOP} - 3 + a) ELSE a END AS BIGINT) AS activity_count,
        CAST(CASE WHEN ip IN (SELECT ip FROM kept) THEN least({TOP}, {TOP} - 1 + r) ELSE r END AS BIGINT) AS refused_count
      FROM ends JOIN counts USING (ip)""",
    "block_episodes": EPISODES,
    "block_starts": f"""{scored_sql(0)} SELECT ip, min(ts) AS blocked_from, CAST(NULL AS BIGINT) AS blocked_until FROM fold
        WHERE s > 100 GROUP BY ip""",
    "blocked_now": f"{STATE} SELECT ip, NOT whitelisted AND (blacklisted OR {OVER}) AS blocked FROM state",
    "status_label": f"{STATE} SELECT ip, {STATUS} AS status FROM state",
    "firewall_plan": PLAN,
    "firewall_plan_without_decay": PLAN_NO_DECAY,
    "state_after_plan": f"""WITH plan AS ({PLAN}), {KEPT}
        SELECT k.ip, coalesce(p.action IN ('ADD', 'KEEP'), false) AS has_rule FROM kept k LEFT JOIN plan p USING (ip)""",
    "parse_firewall_rules": f"WITH {LISTING} SELECT ip, ip_version, line FROM parsed",
    "unknown_rules": f"""WITH {LISTING}, {KEPT}, {FEEDS} SELECT ip, ip_version, line FROM parsed
        WHERE ip NOT IN (SELECT ip FROM kept) AND ip NOT IN (SELECT ip FROM old_feed)""",
    "template_migration": f"""WITH {LISTING}
        SELECT ip, ip_version, 'REMOVE' AS action, {TOOL} || ' -D INPUT -s ' || ip || ' -j DROP' AS command FROM parsed
        UNION ALL SELECT ip, ip_version, 'ADD', {TOOL} || ' -A INPUT -s ' || ip || ' -j LOG_AND_DROP' FROM parsed""",
    "sync_rule_flag": f"""WITH {KEPT}, {FEEDS}
        SELECT 'state' AS side, k.ip, k.has_rule OR coalesce(f.has_rule, false) AS has_rule FROM kept k LEFT JOIN old_feed f USING (ip)
        UNION ALL SELECT 'feed', f.ip, f.has_rule OR coalesce(k.has_rule, false) FROM old_feed f LEFT JOIN kept k USING (ip)""",
    "summary": f"""{STATE}, {FEEDS}
        SELECT count(*) AS addresses, CAST(sum(activity_count) AS BIGINT) AS total_activity,
          CAST(sum(refused_count) AS BIGINT) AS total_refused, count(*) FILTER (whitelisted) AS total_whitelisted,
          count(*) FILTER (blacklisted AND NOT whitelisted) AS total_blacklisted,
          count(*) FILTER (NOT whitelisted AND (blacklisted OR {OVER})) AS total_blocked,
          (SELECT count(*) FROM old_feed) AS feed_size, (SELECT min(ts) FROM ev) AS sync_time, (SELECT min(ts) - 60 FROM ev) AS gen_time
        FROM state""",
    "top_active": f"""{STATE} SELECT ip, activity_count, score, refused_count, last_activity, {STATUS} AS status FROM state
        ORDER BY activity_count + refused_count DESC, ip LIMIT 5""",
    "last_active": f"""{STATE} SELECT ip, activity_count, score, refused_count, last_activity, {STATUS} AS status FROM state
        ORDER BY last_activity DESC, ip LIMIT 5""",
    "list_blocked": f"{STATE} SELECT ip FROM state WHERE NOT whitelisted AND (blacklisted OR {OVER}) ORDER BY ip",
    "list_all": f"{STATE} SELECT ip, activity_count, score, refused_count, last_activity FROM state ORDER BY ip",
    "feed_diff": f"{DIFF} SELECT * FROM diff",
    "feed_counts": f"{DIFF} SELECT action, count(*) AS n FROM diff GROUP BY action",
    "feed_apply": f"{DIFF} SELECT ip, total_reports, confidence, ip_version, has_rule FROM diff WHERE action <> 'removed'",
    "feed_except": f"""WITH {FEEDS} SELECT ip, 'removed' AS change FROM (SELECT ip FROM old_feed EXCEPT SELECT ip FROM new_feed)
        UNION ALL SELECT ip, 'new' FROM (SELECT ip FROM new_feed EXCEPT SELECT ip FROM old_feed)""",
    "feed_save": f"""{DIFF} SELECT d.ip, coalesce(n.total_reports, o.total_reports) AS total_reports,
          CAST(CASE WHEN n.ip IS NULL THEN o.confidence ELSE least(100, n.confidence * 2) END AS INTEGER) AS confidence, d.ip_version, d.has_rule
        FROM diff d LEFT JOIN new_feed n ON n.ip = d.ip LEFT JOIN old_feed o ON o.ip = d.ip""",
    "feed_generation": f"""WITH {EV} SELECT min(ts) - 60 AS old_gen, max(ts) - 60 AS new_gen,
        CASE WHEN min(ts) > max(ts) THEN 'older' WHEN min(ts) = max(ts) THEN 'same' ELSE 'newer' END AS result FROM ev""",
    "feed_sync_due": f"""WITH {EV} SELECT user_id, max(ts) + 300 AS retry_time, {AS_OF} - max(ts) >= 86400 AS due FROM ev GROUP BY user_id""",
    "feed_plan": f"""{DIFF}, {KEPT}, facts AS (
        SELECT e.ip, k.ip IS NOT NULL AS in_state, n.ip IS NOT NULL AS in_feed, coalesce(n.confidence, 0) AS confidence,
          coalesce(k.whitelisted, false) AS wl, coalesce(k.blacklisted, false) AS bl, k.last_activity, k.score,
          coalesce(o.has_rule, false) OR coalesce(k.has_rule, false) AS has_rule, o.ip IS NOT NULL AND n.ip IS NULL AS gone,
          CASE WHEN contains(e.ip, ':') THEN 6 ELSE 4 END AS ip_version
        FROM (SELECT ip FROM kept UNION SELECT ip FROM old_feed UNION SELECT ip FROM new_feed) e
        LEFT JOIN kept k ON k.ip = e.ip LEFT JOIN old_feed o ON o.ip = e.ip LEFT JOIN new_feed n ON n.ip = e.ip),
      acts AS (SELECT *, CASE
          WHEN NOT in_state AND NOT in_feed THEN CASE WHEN gone THEN 'REMOVE' ELSE 'UNKNOWN' END
          WHEN has_rule AND in_state AND (wl OR (NOT bl AND NOT in_feed AND {AS_OF} > last_activity + score)) THEN 'REMOVE'
          WHEN has_rule THEN 'KEEP'
          WHEN NOT wl AND (bl OR (in_feed AND confidence >= 90) OR (in_state AND score > 0 AND {OVER})) THEN 'ADD' END AS action
        FROM facts)
      SELECT ip, ip_version, action, CASE action WHEN 'ADD' THEN {TOOL} || ' -I INPUT 1 -s ' || ip || ' -j DROP'
          WHEN 'REMOVE' THEN {TOOL} || ' -D INPUT -s ' || ip || ' -j DROP' END AS command
      FROM acts WHERE action IS NOT NULL""",
    "report_settings": f"WITH {CANDIDATES} SELECT seq, kind, ip, categories, comment FROM candidates",
    "throttle": f"{chosen_sql()} SELECT ip, ts, seq FROM emitted",
    "rendered_reports": RENDERED,
    "last_reported": f"""{chosen_sql()} SELECT k.ip, greatest(k.last_reported, coalesce(max(e.ts), 0)) AS last_reported
        FROM kept k LEFT JOIN emitted e ON e.ip = k.ip GROUP BY k.ip, k.last_reported""",
    "rate_limited": f"""WITH {HITS} SELECT seq, ts, ip FROM hits h WHERE NOT EXISTS (
        SELECT 1 FROM ev p WHERE p.seq * 37 % 5000 > 4900 AND h.ts >= p.ts AND h.ts < p.ts + greatest(p.seq * 37 % 5000 - 4900, 0) * 60)""",
    "category_names": f"""WITH {CANDIDATES}, names(category, category_name) AS (VALUES {CATEGORY_VALUES}),
        one AS (SELECT seq, kind, CAST(unnest(string_split(categories, ',')) AS INTEGER) AS category FROM candidates)
        SELECT seq, kind, category, category_name FROM one LEFT JOIN names USING (category)""",
    "mask_text": """SELECT doc_id, replace(replace(replace(replace(text, 'an', '**'), 'The', '***'), '10', '**'), '.', '*') AS masked
        FROM documents""",
    "mask_list": """WITH hosts AS (SELECT lower(replace(s_name, '#', '-')) AS name, s_suppkey AS k FROM supplier)
        SELECT name || '.example.org' AS text FROM hosts WHERE k % 2 = 0 UNION SELECT name FROM hosts
        UNION SELECT 'fe80::' || printf('%x', k + 1) FROM hosts""",
    "comment_rendering": DOC_RENDERED,
    "payload": f"""SELECT doc_id, 'categories=14,' || (doc_id % 20 + 3) || '&comment=' || {url_sql('text')}
        || '&ip=10.0.0.' || (doc_id % 250) AS payload FROM documents""",
    "ip_version": f"""WITH {EV}, spelled AS (SELECT seq, CASE WHEN user_id % 11 = 0 THEN '010.' || raw WHEN user_id % 13 = 0 THEN raw || ':'
          ELSE raw END AS raw FROM ev)
        SELECT seq AS event_id, raw, CASE WHEN regexp_matches(raw, '{STRICT_V4}') THEN 4
          WHEN regexp_matches(raw, '{V6_TEXT}') THEN 6 ELSE -1 END AS version FROM spelled""",
    "ip6_format": f"""WITH {EV} SELECT seq AS event_id, CASE WHEN user_id % 5 = 0 THEN ip END AS canonical, ip AS normal FROM ev""",
    "trim": r"""WITH t AS (SELECT doc_id, lang, chr(32) || chr(9) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END
          || chr(13) || chr(10) || chr(32) AS x FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(x, '[^ \t\n\r]') THEN ltrim(x, chr(32) || chr(9) || chr(10) || chr(13)) ELSE x END AS left_done,
          CASE WHEN regexp_matches(x, '[^ \t\n\r]') THEN rtrim(x, chr(32) || chr(9) || chr(10) || chr(13)) ELSE x END AS right_done,
          lower(lang) AS lang FROM t""",
    "format_epoch": """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS standard,
        strftime(date_trunc('second', ts), '%d/%m/%y at %H o''clock') AS other,
        strftime(ts, '%U %W %V %G %u %w ') || right(strftime(ts, '%G'), 2) || ' ' || left(strftime(ts, '%Y'), 2) AS weeks,
        lpad(strftime(ts, '%-d'), 2, ' ') || '|' || lpad(strftime(ts, '%-H'), 2, ' ') || '|' || lpad(strftime(ts, '%-I'), 2, ' ') || '|'
          || CAST(floor(epoch(ts)) AS BIGINT) || '|' || lower(strftime(ts, '%p')) AS padded,
        strftime(ts, '%m/%d/%y %H:%M:%S %d') AS composed,
        strftime(ts, '%a %b ') || lpad(strftime(ts, '%-d'), 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS whole FROM events""",
    "offset_times": f"""WITH {EV} SELECT seq AS event_id, ts - CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * (seq % 13 * 3600 + 1800) AS seconds FROM ev""",
    "headers": """SELECT event_id, 3 AS n, CAST(event_id % 900 AS VARCHAR) AS retry_after, event_type AS x_type FROM events""",
    "categories": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 30 AS VARCHAR)
        ELSE (event_id % 30) || ',' || user_id || ',22' END AS parsed FROM events""",
    "scalar_parsers": f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS number,
        CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, greatest(25, least(100, event_id % 200)) AS feed_score,
        least(100, event_id % 200) AS confidence, least(4294967000 + event_id + user_id, {TOP}) AS sum_u32 FROM events""",
    "state_import": f"""WITH {STATE_LINES}, firsts AS (SELECT ip, min(seq) AS seq FROM lines GROUP BY ip)
        SELECT l.ip, last_activity, score, activity_count, refused_count, whitelisted, blacklisted, last_reported, ip_version,
          false AS has_rule FROM lines l JOIN firsts f ON f.seq = l.seq""",
    "state_duplicates": f"WITH {STATE_LINES} SELECT ip, count(*) AS copies FROM lines GROUP BY ip HAVING count(*) > 1",
    "feed_import": f"""WITH f AS (SELECT {ip_sql('(c_custkey % 1000)', True)} AS ip, min(c_custkey) AS k FROM customer GROUP BY 1)
        SELECT ip, k AS total_reports, CAST(k % 101 AS INTEGER) AS confidence, {VERSION} AS ip_version, false AS has_rule FROM f""",
    "bookmark_import": """SELECT '/var/log/' || p_brand || (p_partkey % 40) AS path, max(p_partkey) * 10 AS bookmark,
        max(p_partkey) * 11 AS size FROM part GROUP BY 1""",
    "sync_import": "SELECT max(o_orderkey) AS sync_time, max(o_orderkey) * 2 AS gen_time FROM orders",
    "state_load_report": """WITH n AS (SELECT (SELECT count(DISTINCT user_id) FROM events) AS addresses,
          (SELECT count(DISTINCT c_custkey % 1000) FROM customer) AS feed_rows, (SELECT count(*) FROM supplier) AS removed,
          (SELECT count(*) - count(DISTINCT user_id) FROM events) AS d, (SELECT count(*) - count(DISTINCT c_custkey % 1000) FROM customer) AS f)
        SELECT addresses, feed_rows, removed, d + f AS duplicates, true AS needs_upgrade, true AS rewrite FROM n""",
    "rules_load": f"WITH {CONFIG} SELECT config, log_group, kind, rule_idx, pattern, CAST(score AS BIGINT) AS score, report, categories, comment FROM rules",
    "rules_compile": f"""WITH {CONFIG} SELECT config, log_group, kind, rule_idx,
        CASE WHEN kind = 'refused' THEN 2 WHEN rule_idx = 0 THEN 1 ELSE -1 END AS port_pos,
        CASE WHEN kind = 'refused' THEN 2 ELSE 1 END AS ip_group,
        replace(replace(pattern, '%p', '{PORT_PATTERN}'), '%i', '({IP_PATTERN})') AS regex FROM rules""",
    "rules_rejected": f"WITH {CONFIG} SELECT config, log_group, 'activity' AS kind, 'no address here' AS pattern FROM sup",
    "groups_load": f"WITH {CONFIG} SELECT config, log_group, CAST(group_idx AS INTEGER) AS group_idx, (k % 20 + 3) || ',22' AS categories FROM sup",
    "files_load": f"""WITH {CONFIG} SELECT config, log_group, CAST(group_idx AS INTEGER) AS group_idx, 0 AS file_idx,
        '/var/log/' || log_group AS path FROM sup""",
    "settings_load": """SELECT CAST(n_nationkey AS VARCHAR) AS config, CAST(n_nationkey AS BIGINT) AS block_score, CAST(3600 AS BIGINT) AS multiplier,
        CAST(greatest(25, least(100, n_nationkey * 9)) AS BIGINT) AS feed_block_score,
        CASE WHEN n_nationkey % 2 = 0 THEN '-s %i -j LOG' ELSE '-s %i -j DROP' END AS rule_template, false AS reporting_enabled FROM nation""",
    "toggle_blacklist": toggle_sql("blacklisted", "whitelisted"),
    "toggle_whitelist": toggle_sql("whitelisted", "blacklisted"),
    "remove_addresses": f"WITH {KEPT}, {FEEDS} SELECT * FROM kept WHERE ip NOT IN (SELECT ip FROM old_feed)",
    "unknown_removals": f"WITH {KEPT}, {FEEDS} SELECT ip FROM old_feed WHERE ip NOT IN (SELECT ip FROM kept)",
    "removal_plan": f"""WITH {LISTING}, {FEEDS} SELECT ip, ip_version, 'REMOVE' AS action,
        {TOOL} || ' -D INPUT -s ' || ip || ' -j DROP' AS command FROM parsed WHERE ip IN (SELECT ip FROM old_feed)""",
    "bookmarks_rotation": f"""WITH {MARKS}, {FILES} SELECT path, CASE WHEN length < size THEN 0 ELSE bookmark END AS bookmark, size,
        coalesce(length < size, false) AS rotated FROM marks LEFT JOIN files USING (path)""",
    "bookmarks_advance": f"""WITH {MARKS}, {FILES}, ends AS (
        SELECT '/var/log/' || l_partkey AS path, max(l_orderkey) * 10 AS e FROM lineitem GROUP BY 1)
        SELECT path, coalesce(e, bookmark) AS bookmark, coalesce(length, size) AS size, coalesce(e, bookmark) <> bookmark AS changed
        FROM marks LEFT JOIN ends USING (path) LEFT JOIN files USING (path)""",
    "bookmarks_reconcile": f"""WITH {MARKS}, {FILES} SELECT path, coalesce(bookmark, 0) AS bookmark, coalesce(size, 0) AS size
        FROM files LEFT JOIN marks USING (path)""",
    "bookmarks_dropped": f"WITH {MARKS}, {FILES} SELECT * FROM marks WHERE path NOT IN (SELECT path FROM files)",
    "feed_read": f"""SELECT {ip_sql('c_custkey', True)} AS ip, c_custkey AS total_reports, CAST(c_custkey % 101 AS INTEGER) AS confidence,
        CASE WHEN c_custkey % 5 = 0 THEN 6 ELSE 4 END AS ip_version, false AS has_rule FROM customer WHERE c_custkey % 101 >= 75""",
    "feed_read_time": "SELECT CAST(1558368000 + max(c_nationkey) AS BIGINT) AS gen_time FROM customer",
    "checks_read": f"""SELECT {ip_sql('c_custkey', True)} AS ip, c_custkey % 2 = 0 AS is_public, 4 AS ip_version, c_custkey % 3 = 0 AS is_whitelisted,
        CAST(c_custkey % 101 AS INTEGER) AS confidence, 'LV' AS country_code, c_custkey AS total_reports,
        CASE WHEN c_custkey % 5 <> 0 THEN 1558371600 + c_custkey % 60 ELSE 0 END AS last_reported_at FROM customer""",
    "check_reports": f"""WITH c AS (SELECT *, {ip_sql('c_custkey', True)} AS ip FROM customer)
        SELECT ip, 1558371600 + c_custkey % 60 AS reported_at, c_name AS comment, '18,' || (c_custkey % 20 + 3) AS categories,
          c_custkey AS reporter_id, 'LV' AS reporter_country_code, 'Latvia' AS reporter_country_name
        FROM c JOIN (VALUES (1), (2)) twice(n) ON c_custkey % 4 = 0
        UNION ALL SELECT ip, NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE c_custkey % 4 <> 0""",
    "stream_equals_batch": f"{STATE} SELECT ip, last_activity, score, activity_count, refused_count FROM state",
    "monitor_expiry": f"""{STATE}, blocked AS (SELECT ip FROM state WHERE {OVER_AT_END})
        SELECT ip, action FROM blocked, (VALUES ('ADD'), ('REMOVE')) a(action)""",
    "monitor_template": f"""{STATE}, blocked AS (
          SELECT ip, CASE WHEN ip LIKE '%:%' THEN 'ip6tables' ELSE 'iptables' END AS tool FROM state WHERE {OVER_AT_END})
        SELECT ip, 'ADD' AS action, tool || ' -I INPUT 1 -s ' || ip || ' -j DROP' AS command FROM blocked UNION ALL
        SELECT ip, 'REMOVE', tool || ' -D INPUT -s ' || ip || ' -j DROP' FROM blocked UNION ALL
        SELECT ip, 'ADD', tool || ' -I INPUT 1 -s ' || ip || ' -j REJECT' FROM blocked""",
    "monitor_feed_sync": f"""WITH {FEEDS} SELECT ip, confidence, confidence >= 90 AS has_rule, 2 AS fetches FROM new_feed""",
    "outbox_files": f"SELECT ip, ts, comment FROM ({RENDERED_PLAIN})",
    "plan_files": f"SELECT command FROM ({PLAN}) WHERE command IS NOT NULL",
    "listing_files": f"WITH {LISTING} SELECT CAST(ip_version AS INTEGER) AS ip_version, line FROM listing",
    "scan_files": f"""WITH {LINES} SELECT log_group, CAST(CASE log_group WHEN 'OpenSSH' THEN 0 ELSE 1 END AS INTEGER) AS group_idx,
        CAST(7 AS BIGINT) AS ts, line FROM log_lines""",
    "tail_files": f"""WITH {LINES} SELECT log_group, CAST(CASE log_group WHEN 'OpenSSH' THEN 0 ELSE 1 END AS INTEGER) AS group_idx,
        CAST(7 AS BIGINT) AS ts, line FROM log_lines""",
    "stream_reports": f"""{STATE}, seconds AS MATERIALIZED (SELECT DISTINCT ip, ts FROM fold),
        spaced AS (SELECT ip, min(ts) AS ts FROM seconds GROUP BY ip UNION ALL
          SELECT p.ip, (SELECT min(s.ts) FROM seconds s WHERE s.ip = p.ip AND s.ts >= p.ts + 900) FROM spaced p WHERE p.ts IS NOT NULL)
        SELECT ip, score, max(ts) AS last_reported, count(ts) AS reports, max(ts) AS newest
        FROM state JOIN spaced USING (ip) GROUP BY ip, score""",
    "two_writers": f"{STATE} SELECT ip, last_activity, score, activity_count, refused_count FROM state",
    "monitor_reconcile": f"""{STATE}, listed AS (SELECT DISTINCT ip FROM ev WHERE user_id % 3 = 0 AND user_id % 7 <> 0)
        SELECT ip, CASE WHEN ip IN (SELECT ip FROM listed) THEN {AS_OF} <= last_activity + score
          ELSE score > 0 AND {OVER} END AS has_rule FROM state""",
    "report_delivery": f"""{chosen_sql()}, r AS (SELECT DISTINCT ip, ts FROM emitted),
        span AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS low, CAST(floor(epoch(max(ts))) AS BIGINT) AS high FROM events),
        busy AS (SELECT ts, min(ip) AS ip FROM r WHERE ts % 50 = 0 GROUP BY ts),
        pauses AS (SELECT min(ts) AS ts FROM busy UNION ALL
          SELECT (SELECT min(b.ts) FROM busy b WHERE b.ts >= p.ts + 3600) FROM pauses p WHERE p.ts IS NOT NULL),
        begun AS (SELECT ts, ip FROM pauses JOIN busy USING (ts)),
        first_time AS (SELECT ip, ts, CASE WHEN EXISTS (SELECT 1 FROM begun b
              WHERE b.ts < r.ts AND r.ts < b.ts + 3600 OR b.ts = r.ts AND r.ip > b.ip) THEN 'paused'
            WHEN ts % 50 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM r),
        again AS (SELECT ip, ts, CASE WHEN outcome = 'ok' THEN 'repeated' ELSE 'paused' END AS outcome FROM first_time, span
          WHERE (ts - low) * 3 < high - low + 1)
        SELECT outcome, count(*) AS n, count(DISTINCT (ip, ts)) AS reports
        FROM (SELECT * FROM first_time UNION ALL SELECT * FROM again) GROUP BY outcome""",
    "monitor_state": f"{STATE} SELECT ip, last_activity, score, activity_count, refused_count FROM state",
    "report_responses": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'ok' WHEN 3 THEN 'rejected'
          ELSE 'unreadable' END AS outcome,
        CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'order ' || o_orderkey ELSE '' END AS errors,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 900 ELSE 0 END AS retry_after FROM orders""",
}
