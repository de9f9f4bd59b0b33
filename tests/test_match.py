import random

from pyspark.sql import functions as F

from logwarden import Settings, rulesets, schemas
from logwarden.operators import block, known, match, report, rules, state, stats
from logwarden.schemas import FEED_META

DROP = "Mar 14 21:09:02 gate kernel: [77.5] IPTABLES-DROPPED: IN=wan0 SRC={} DST=198.51.100.3 PROTO=TCP DPT={} WINDOW=9"
SSH = "Mar 14 21:08:57 gate sshd[4411]: {}"
LINES = [
    SSH.format("Did not receive identification string from 203.0.113.5 port 50022"),
    DROP.format("203.0.113.5", 3306),
    SSH.format("Accepted publickey for ops from 203.0.113.77 port 2200 ssh2"),
    SSH.format("Failed password for invalid user oracle from 203.0.113.8 port 6022 ssh2"),
    SSH.format("User backup from 203.0.113.9 not allowed because not listed in AllowUsers"),
    DROP.format("203.0.113.200", 23),
    SSH.format("ROOT LOGIN REFUSED FROM 203.0.113.8"),
    DROP.format("203.0.113.8", 22),
    SSH.format("error: PAM: Authentication failure for www from 203.0.113.9"),
    SSH.format("Invalid user test from 203.0.113.31"),
    SSH.format("Server listening on 0.0.0.0 port 22."),
    DROP.format("203.0.113.9", 8090),
]
EXPECTED = {
    1: ("activity", 6, 1, "203.0.113.5", 50022), 2: ("refused", 10, 5, "203.0.113.5", 3306),
    4: ("activity", 14, 2, "203.0.113.8", 6022), 5: ("activity", 7, 2, "203.0.113.9", None),
    6: ("refused", 10, 5, "203.0.113.200", 23), 7: ("activity", 3, 20, "203.0.113.8", None),
    8: ("refused", 0, 5, "203.0.113.8", None), 9: ("activity", 2, 1, "203.0.113.9", None),
    10: ("activity", 0, 2, "203.0.113.31", None), 12: ("refused", 10, 5, "203.0.113.9", 8090),
}


def lines_of(spark, texts, group="OpenSSH"):
    rows = [(group, 1_000_000, n, t) for n, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "log_group string, ts long, seq long, line string")


def test_syslog_lines_to_state(spark):
    hits = match.match_rules(lines_of(spark, LINES), rulesets.builtin_rules(spark)).cache()
    got = {r["seq"]: (r["kind"], r["rule_idx"], r["score"], r["ip"], r["port"]) for r in hits.collect()}
    assert got == EXPECTED
    after = state.state_from_hits(known.known_refused(hits), 3600).cache()
    assert {r["ip"]: (r["score"], r["activity_count"], r["refused_count"]) for r in after.collect()} == {
        "203.0.113.5": (21600, 1, 1), "203.0.113.8": (97200, 2, 1), "203.0.113.9": (28800, 2, 1), "203.0.113.31": (7200, 1, 0)}
    settings = Settings()
    blocked = {r["ip"] for r in after.filter(block.blocked_now(settings, 1_000_000)).collect()}
    assert blocked == {"203.0.113.8"}
    total = stats.summary(after, spark.createDataFrame([], schemas.FEED), spark.createDataFrame([(0, 0)], FEED_META),
                          settings, 1_000_000).first()
    assert (total["addresses"], total["total_activity"], total["total_refused"], total["total_blocked"]) == (4, 6, 3, 1)
    top = [r["ip"].rsplit(".")[-1] for r in stats.top_active(after, settings, 1_000_000).collect()]
    assert top == ["8", "9", "5", "31"]


def test_web_lines(spark):
    tail = ' - - [14/Mar/2019:21:10:00 +0100] "POST {} HTTP/2" 403 9 "-" "probe"'
    texts = ["198.51.100.7" + tail.format(p) for p in (
        "/index.html", "/old/phpmyadmin/x.php", "/cgi-bin/login.cgi?u=1", "/shop/cart")]
    hits = match.match_rules(lines_of(spark, texts, "ApacheAccess"), rulesets.builtin_rules(spark, ("ApacheAccess",)))
    assert {r["seq"]: r["ip"] for r in hits.collect()} == {2: "198.51.100.7", 3: "198.51.100.7"}


def test_own_rules(spark):
    rows = [
        ("G", 0, "activity", 0, r"port %p (a|b) from %i", 1, None, [], None),
        ("G", 0, "activity", 1, r"x[(] (a) %i.*", 2, None, [], None),
        ("G", 0, "refused", 0, r"x.*%i", 3, None, [], None),
        ("H", 1, "activity", 0, r"%i", 4, None, [], None),
    ]
    own = spark.createDataFrame(rows, schemas.RULES)
    texts = ["port 22 b from 2001:DB8::1", "X( a 1.2.3.4\r", "x( A 01.2.3.4", "::FFFF:1.2.3.4", "x 999.1.1.1"]
    hits = match.match_rules(lines_of(spark, texts, "G"), own)
    got = sorted((r["seq"], r["kind"], r["score"], r["ip"], r["ip_version"], r["port"]) for r in hits.collect())
    assert got == [
        (1, "activity", 1, "2001:db8::1", 6, 22),
        (3, "activity", 2, "01.2.3.4", -1, None), (3, "refused", 3, "1.2.3.4", 4, None),
        (5, "refused", 3, "9.1.1.1", 4, None),
    ]
    other = match.match_rules(lines_of(spark, texts, "H"), own)
    assert [(r["seq"], r["ip"]) for r in other.collect()] == [(4, "::ffff:1.2.3.4")]
    nothing = match.match_rules(lines_of(spark, texts, "none"), own.limit(0))
    assert nothing.count() == 0 and nothing.columns == match.HIT_COLUMNS


PIECES = [
    "ab", "Z", r"\x41", r"\u0042", r"\x{43}", r"\cJ", r"\.", r"\d", "[xyz]", "[^a]", r"[\]q]", "[[:digit:]]", "[[:alpha:][:punct:]]",
    "(de|f)", "(gh)?", "k*", "m+", "n?", "o{2}", ".", " ", "-", r"\p{Alpha}", r"\/", "=",
]


def test_prefilter_never_drops_what_the_regex_matches(spark):
    """Generated rules and lines: the same hits as the bare regex gives."""
    pick = random.Random(5)
    patterns = ["^%i " + "".join(pick.choice(PIECES) for _ in range(pick.randint(1, 7))) for _ in range(150)]
    own = spark.createDataFrame([(f"g{k}", k, "activity", 0, p, 1, None, [], None) for k, p in enumerate(patterns)], schemas.RULES)
    chars = ["ab", "z", "A", "b", "C", "\n", ".", "7", "x", "q", "]", "de", "f", "gh", "k", "mm", "n", "oo", " ", "-", "/", "="]
    usable = {r["log_group"]: r["regex"] for r in rules.usable_rules(own)}
    assert len(usable) == len(patterns)
    rows = [(f"g{k}", 1, k * 100 + j, "10.0.0.1 " + "".join(pick.choice(chars) for _ in range(pick.randint(1, 6))))
            for k in range(len(patterns)) for j in range(60)]
    lines = spark.createDataFrame(rows, "log_group string, ts long, seq long, line string")
    got = {r["seq"] for r in match.match_rules(lines, own).collect()}
    java = spark._jvm.java.util.regex.Pattern
    engines = {g: java.compile(match.whole_line(regex)) for g, regex in usable.items()}
    want = {seq for g, _, seq, line in rows if engines[g].matcher(line).matches()}
    assert got == want and want


def test_groups_of_one_name(spark):
    own = spark.createDataFrame([("A", 0, "activity", 0, "%i x", 1, None, [3], None), ("B", 1, "activity", 0, "%i y", 2, None, [4], None),
                                 ("A", 2, "activity", 0, "%i z", 3, None, [5], None)], schemas.RULES)
    groups = spark.createDataFrame([("A", 0, True, [], None), ("B", 1, True, [], None), ("A", 2, True, [], None)], schemas.GROUPS)
    hits = match.match_rules(lines_of(spark, ["1.1.1.1 x", "1.1.1.1 y", "1.1.1.1 z"], "A"), own)
    asked = report.report_settings(hits, rules.resolve_report_settings(own, groups, Settings()))
    assert sorted((r["seq"], r["score"], r["categories"]) for r in asked.collect()) == [(1, 1, [3]), (3, 3, [5])]


def test_required_texts_are_in_every_matching_line():
    assert rules.required_texts(r"^.+? sshd\[\d+\]: from %i") == ["]: from ", " sshd["]
    assert rules.required_texts(r"ab+c(def|g)?hij|x") == []
    assert rules.required_texts(r"ab*c{2}(def)[xyz]ghi\.j") == ["ghi.j"]
    assert rules.required_texts(r"A?BC %i") == ["bc "]


def test_hot_address_is_cut_into_pieces(spark):
    from logwarden.operators.skew import hot_keys, salted_join

    facts = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("ip"), "id")
    counts = facts.groupBy("ip").agg(F.count("*").alias("n"))
    hot = {r["ip"]: r["pieces"] for r in hot_keys(counts, "ip").collect()}
    assert hot == {"hot": 6}
    dim = facts.select("ip").distinct().withColumn("v", F.length("ip"))
    joined = salted_join(facts, dim, "ip", counts)
    assert joined.count() == 1000 and joined.filter("v = 3 and ip = 'hot'").count() == 700
