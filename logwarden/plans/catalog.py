"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import functions as fn
from logwarden import rulesets, schemas
from logwarden.operators import block, feed, firewall, known, match, report, rules, score, state, stats
from logwarden.plans import demo, log_check
from logwarden.plans.demo import AS_OF, table
from logwarden.settings import Settings
from logwarden.sources import config_file, logs, reputation, sinks, state_file, tail
from logwarden.sources.firewall_rules import read_firewall_rules
from logwarden.stage import adopt, shared_folder, written
from logwarden.streaming.delivery import Delivery
from logwarden.streaming.monitor import Monitor

SETTINGS = Settings(report_all=True, default_comment="%d %i port %p: %m")


def demo_rules(spark: SparkSession) -> DataFrame:
    return rulesets.builtin_rules(spark, demo.GROUPS)


def demo_groups(spark: SparkSession) -> DataFrame:
    rows = [("OpenSSH", 0, None, [18, 22], None), ("ApacheAccess", 1, None, [], "%i asked for it at %d")]
    return spark.createDataFrame(rows, schemas.GROUPS)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_rules(demo.log_lines(spark, sf_dir), demo_rules(spark))


COUNTED = ("seq", "ts", "kind", "score", "ip", "ip_version")


def hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Hits as a table: matching is the costly pass, and what follows reads them several
    times. With ``columns`` only those are written down."""
    found = matched(spark, sf_dir)
    return written(found.select(*columns) if columns else found)


def counted_hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Hits without refused ones of unknown addresses."""
    return known.known_refused(hits(spark, sf_dir, *columns))


def scored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_from_hits(counted_hits(spark, sf_dir, *COUNTED), SETTINGS.multiplier)


def listed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored state with some addresses on the lists, chosen by their last seconds."""
    seconds = F.col("last_activity") % 17
    return (
        scored_state(spark, sf_dir)
        .withColumn("whitelisted", seconds == 0)
        .withColumn("blacklisted", seconds == 1)
    )


# -- lines to hits ----------------------------------------------------------------


def match_first_rule(spark, sf_dir):
    return matched(spark, sf_dir).filter("kind = 'activity'").drop("group_idx")


def match_refused(spark, sf_dir):
    return matched(spark, sf_dir).filter("kind = 'refused'").drop("group_idx")


def _own_rules(spark, patterns):
    """Activity rules (group, group number, pattern, score, categories)."""
    rows = [(g, n, "activity", k, p, s, True, c, None) for k, (g, n, p, s, c) in enumerate(patterns)]
    return spark.createDataFrame(rows, schemas.RULES)


def match_escapes(spark, sf_dir):
    """Rules that write characters by number."""
    own = _own_rules(spark, [
        ("OpenSSH", 0, r"^.+? R\x4F\u004FT LOGIN REFUSED FROM\x20%i", 7, []),
        ("OpenSSH", 0, r"^.+? Invalid\cJ? user \p{Alnum}+ from %i port %p", 8, []),
        ("ApacheAccess", 1, r"^%i .+?GET [\]/]php\x{4d}yAdmin[/\]] HTTP.*", 9, []),
    ])
    found = match.match_rules(demo.log_lines(spark, sf_dir), own)
    return found.select("seq", "rule_idx", "score", "ip", "port")


def match_posix(spark, sf_dir):
    """Rules with named character classes."""
    own = _own_rules(spark, [
        ("OpenSSH", 0, r"^.+? sshd\[[[:digit:]]+\]: ROOT LOGIN[[:space:]]REFUSED FROM %i", 7, []),
        ("OpenSSH", 0, r"^.+? Invalid user [^[:space:][:punct:]]+ from %i port %p", 8, []),
        ("ApacheAccess", 1, r"^%i [^[:alpha:]]+\[[[:xdigit:][:punct:]]+[[:alpha:]]+.*GET /[[:lower:]]+Admin/.*", 9, []),
    ])
    found = match.match_rules(demo.log_lines(spark, sf_dir), own)
    return found.select("seq", "rule_idx", "score", "ip", "port")


def match_long_list(spark, sf_dir):
    """A thousand rules of one group, most of them for a beginning that two user names share."""
    patterns = [("OpenSSH", 0, rf"^.+? Invalid user u{k}[0-9]? from %i port %p", k % 50 + 1, []) for k in range(1000)]
    patterns.insert(500, ("OpenSSH", 0, r"^.+? (?:ROOT|root) LOGIN REFUSED FROM %i", 60, []))
    patterns.insert(700, ("OpenSSH", 0, r"^\w+\s+\d+[^a-z]+\w+\s\w+:\s.+?=%i\s.*", 61, []))
    found = match.match_rules(demo.log_lines(spark, sf_dir), _own_rules(spark, patterns))
    return found.select("seq", "rule_idx", "score", "ip", "port")


def rule_problems(spark, sf_dir):
    """A rule for every supplier, of which some cannot be used."""
    key, name = F.col("s_suppkey"), F.replace("s_name", F.lit("#"), F.lit("-"))
    shapes = [F.lit("%i "), F.lit("(?P<n>b) %i "), F.lit("%i [[:digit:]]+ "), F.lit("(%i "), F.lit("no place "), F.lit("%i [a-")]
    pattern = F.concat(F.element_at(F.array(*shapes), (key % len(shapes) + 1).cast("int")), name)
    own = table(spark, sf_dir, "supplier").select(
        F.lit("G").alias("log_group"), F.lit(0).alias("group_idx"), F.lit("activity").alias("kind"), key.cast("int").alias("rule_idx"),
        pattern.alias("pattern"), F.lit(1).cast("long").alias("score"), F.lit(None).cast("boolean").alias("report"),
        F.array().cast("array<int>").alias("categories"), F.lit(None).cast("string").alias("comment"),
    )
    return rules.rule_problems(own).select("rule_idx", (F.col("error") == "no address placeholder in pattern").alias("no_place"))


def repeated_groups(spark, sf_dir):
    """Two groups of one name, each with its own rules, categories and lines."""
    own = _own_rules(spark, [
        ("OpenSSH", 0, r"^.+? Invalid user .+? from %i port %p", 3, []), ("ApacheAccess", 1, r"^%i .+?/phpMyAdmin/.*", 4, []),
        ("OpenSSH", 2, r"^.+? Invalid user .+? from %i port %p", 5, []),
    ]).withColumn("rule_idx", F.lit(0))
    groups = spark.createDataFrame(
        [("OpenSSH", 0, None, [18], None), ("ApacheAccess", 1, None, [21], None), ("OpenSSH", 2, None, [22, 15], None)], schemas.GROUPS
    )
    lines = demo.log_lines(spark, sf_dir)
    place = F.when(F.col("log_group") == "ApacheAccess", 1).when(F.col("seq") % 2 == 0, 0).otherwise(2)
    found = match.match_rules(lines.withColumn("group_idx", place), own)
    resolved = rules.resolve_report_settings(own, groups, SETTINGS)
    return report.report_settings(found, resolved).select(
        "seq", "group_idx", "score", "ip", fn.categories_csv("categories").alias("categories")
    )


def known_refused(spark, sf_dir):
    return known.known_refused(
        hits(spark, sf_dir, *COUNTED, "rule_idx"), demo.kept_state(spark, sf_dir), demo.feed(spark, sf_dir, True)
    ).filter("kind = 'refused'").select("seq", "ts", "ip", "rule_idx", "score")


def unknown_refused(spark, sf_dir):
    return known.unknown_refused(hits(spark, sf_dir, *COUNTED)).select("seq", "ts", "ip")


def attach_state(spark, sf_dir):
    joined = known.attach_state(hits(spark, sf_dir), demo.kept_state(spark, sf_dir))
    return joined.select("seq", "kind", "ip", "score", "last_activity", "activity_count", "whitelisted", "has_rule")


# -- score ------------------------------------------------------------------------


def decayed_score(spark, sf_dir):
    scored = score.decayed_score(counted_hits(spark, sf_dir, *COUNTED), SETTINGS.multiplier)
    return scored.select("ip", "ts", "seq", "kind", "score", "running_score")


def growing_score(spark, sf_dir):
    scored = score.decayed_score(counted_hits(spark, sf_dir, *COUNTED), 0)
    return scored.select("ip", "ts", "seq", "running_score")


def state_after(spark, sf_dir):
    return scored_state(spark, sf_dir)


def state_update(spark, sf_dir):
    before = demo.kept_state(spark, sf_dir)
    counted = known.known_refused(hits(spark, sf_dir, *COUNTED), before)
    return state.update_state(before, counted, SETTINGS.multiplier)


def activity_by_address(spark, sf_dir):
    return score.activity_by_address(matched(spark, sf_dir))


def expiry(spark, sf_dir):
    return scored_state(spark, sf_dir).select("ip", score.expiry().alias("expires_at"))


def saturated_state(spark, sf_dir):
    """Scores and counts close to the limit stop there."""
    top = F.lit(4294967295).cast("bigint")
    full = demo.kept_state(spark, sf_dir)
    full = full.withColumn("score", top).withColumn("activity_count", top - 3).withColumn("refused_count", top - 1)
    changed = state.changed_rows(full, hits(spark, sf_dir, *COUNTED), SETTINGS.multiplier)
    return changed.select("ip", "last_activity", "score", "activity_count", "refused_count")


# -- decisions --------------------------------------------------------------------


def block_episodes(spark, sf_dir):
    steps = score.per_second(counted_hits(spark, sf_dir, *COUNTED), SETTINGS.multiplier)
    return block.block_episodes(steps, SETTINGS)


def block_starts(spark, sf_dir):
    """Without decay blocks never end."""
    forever = Settings(multiplier=0, block_score=100)
    return block.block_episodes(score.per_second(counted_hits(spark, sf_dir, *COUNTED), 0), forever)


def blocked_now(spark, sf_dir):
    return listed_state(spark, sf_dir).select("ip", block.blocked_now(SETTINGS, AS_OF).alias("blocked"))


def status_label(spark, sf_dir):
    return listed_state(spark, sf_dir).select("ip", block.status_label(SETTINGS, AS_OF).alias("status"))


def firewall_plan(spark, sf_dir):
    parsed = firewall.parse_rules(demo.firewall_listing(spark, sf_dir), demo.TEMPLATE)
    blank = demo.kept_state(spark, sf_dir).withColumn("has_rule", F.lit(False))
    fed = demo.feed(spark, sf_dir, False)
    return firewall.firewall_plan(blank, fed, parsed, SETTINGS, demo.GAP_START + 100000)


def firewall_plan_without_decay(spark, sf_dir):
    parsed = firewall.parse_rules(demo.firewall_listing(spark, sf_dir), demo.TEMPLATE)
    forever = Settings(multiplier=0, block_score=100000, append_rules=True)
    return firewall.firewall_plan(demo.kept_state(spark, sf_dir), demo.feed(spark, sf_dir, False), parsed, forever, AS_OF)


def state_after_plan(spark, sf_dir):
    plan = firewall_plan(spark, sf_dir)
    return firewall.apply_plan(demo.kept_state(spark, sf_dir), plan).select("ip", "has_rule")


def parse_firewall_rules(spark, sf_dir):
    return firewall.parse_rules(demo.firewall_listing(spark, sf_dir), demo.TEMPLATE)


def unknown_rules(spark, sf_dir):
    parsed = firewall.parse_rules(demo.firewall_listing(spark, sf_dir), demo.TEMPLATE)
    return firewall.unknown_rules(parsed, demo.kept_state(spark, sf_dir), demo.feed(spark, sf_dir, True))


def template_migration(spark, sf_dir):
    new = Settings(rule_template="-s %i -j LOG_AND_DROP", append_rules=True)
    return firewall.migrate_rule_template(demo.firewall_listing(spark, sf_dir), Settings(), new)


def sync_rule_flag(spark, sf_dir):
    kept, fed = firewall.sync_rule_flag(demo.kept_state(spark, sf_dir), demo.feed(spark, sf_dir, True))
    return kept.select(F.lit("state").alias("side"), "ip", "has_rule").unionByName(
        fed.select(F.lit("feed").alias("side"), "ip", "has_rule")
    )


# -- statistics -------------------------------------------------------------------


def summary(spark, sf_dir):
    return stats.summary(
        listed_state(spark, sf_dir), demo.feed(spark, sf_dir, True), demo.feed_times(spark, sf_dir, True), SETTINGS, AS_OF
    )


def top_active(spark, sf_dir):
    return stats.top_active(listed_state(spark, sf_dir), SETTINGS, AS_OF)


def last_active(spark, sf_dir):
    return stats.last_active(listed_state(spark, sf_dir), SETTINGS, AS_OF)


def list_blocked(spark, sf_dir):
    return stats.list_addresses(listed_state(spark, sf_dir), SETTINGS, AS_OF)


def list_all(spark, sf_dir):
    return stats.list_addresses(listed_state(spark, sf_dir), SETTINGS, AS_OF, every=True, count=True, time=True)


# -- feed -------------------------------------------------------------------------


def _diff(spark, sf_dir):
    return feed.diff_feed(demo.feed(spark, sf_dir, True), demo.feed(spark, sf_dir, False))


def feed_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


def feed_counts(spark, sf_dir):
    return feed.feed_change_counts(_diff(spark, sf_dir))


def feed_apply(spark, sf_dir):
    return feed.apply_feed_diff(_diff(spark, sf_dir))


def feed_except(spark, sf_dir):
    old, new = demo.feed(spark, sf_dir, True), demo.feed(spark, sf_dir, False)
    gone = feed.feed_removals(old, new).select("ip", F.lit("removed").alias("change"))
    return gone.unionByName(feed.feed_additions(old, new).select("ip", F.lit("new").alias("change")))


def feed_save(spark, sf_dir):
    records = demo.feed(spark, sf_dir, False).select("ip", "total_reports", (F.col("confidence") * 2).alias("confidence"))
    return feed.save_feed_records(demo.feed(spark, sf_dir, True), records)


def feed_generation(spark, sf_dir):
    return feed.feed_generation_check(demo.feed_times(spark, sf_dir, True), demo.feed_times(spark, sf_dir, False))


def feed_sync_due(spark, sf_dir):
    users = demo.events_by_user(spark, sf_dir).select("user_id", F.col("last_ts").alias("sync_time"))
    late = feed.sync_failed(users).select("user_id", F.col("sync_time").alias("retry_time"))
    return users.join(late, "user_id").select("user_id", "retry_time", feed.sync_due(86400, AS_OF).alias("due"))


def feed_plan(spark, sf_dir):
    """Firewall plan right after a sync: rules of removed addresses go."""
    diff = _diff(spark, sf_dir)
    parsed = demo.feed(spark, sf_dir, True).filter("has_rule").select("ip", "ip_version", F.lit("").alias("line"))
    return firewall.firewall_plan(
        demo.kept_state(spark, sf_dir), feed.apply_feed_diff(diff), parsed, SETTINGS, AS_OF, feed.removed_from_feed(diff)
    )


# -- reports ----------------------------------------------------------------------


def asked(spark, sf_dir):
    resolved = rules.resolve_report_settings(demo_rules(spark), demo_groups(spark), SETTINGS)
    return report.reportable(report.report_settings(counted_hits(spark, sf_dir), resolved), SETTINGS)


def candidates(spark, sf_dir):
    return report.not_whitelisted(written(asked(spark, sf_dir)), demo.kept_state(spark, sf_dir))


def emitted(spark, sf_dir):
    return report.throttle_reports(written(asked(spark, sf_dir)), demo.kept_state(spark, sf_dir), gap=86400)


def report_settings(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "seq", "kind", "ip", fn.categories_csv("categories").alias("categories"), "comment"
    )


def throttle(spark, sf_dir):
    return emitted(spark, sf_dir).select("ip", "ts", "seq")


def rendered_reports(spark, sf_dir):
    key = F.col("n_nationkey")
    hosts = table(spark, sf_dir, "nation").select(
        F.when(key == 0, "somehost.example.org").otherwise(F.concat(F.lower(F.col("n_name")), F.lit(".test"))).alias("host"),
        F.when(key == 1, "10.9.9.9%eth0").otherwise(F.concat(F.lit("fe80::"), F.hex(key), F.lit("%eth1"))).alias("addr"),
    )
    reports = report.render_reports(emitted(spark, sf_dir), SETTINGS, report.mask_list(hosts))
    return report.with_payload(reports).select("ip", "ts", "comment", "payload")


def last_reported(spark, sf_dir):
    return report.mark_reported(demo.kept_state(spark, sf_dir), emitted(spark, sf_dir)).select("ip", "last_reported")


def rate_limited(spark, sf_dir):
    pauses = table(spark, sf_dir, "events").select(
        fn.epoch_seconds("ts").alias("ts"), (F.greatest(F.col("event_id") * 37 % 5000 - 4900, F.lit(0)) * 60).alias("retry_after")
    )
    return report.suppress_rate_limited(hits(spark, sf_dir, "seq", "ts", "ip"), pauses)


def category_names(spark, sf_dir):
    return report.category_names(candidates(spark, sf_dir).select("seq", "kind", "categories")).select(
        "seq", "kind", "category", "category_name"
    )


def mask_text(spark, sf_dir):
    words = F.array(F.lit("an"), F.lit("The"), F.lit("10"), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", fn.mask("text", words).alias("masked"))


def mask_list(spark, sf_dir):
    hosts = table(spark, sf_dir, "supplier").select(
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.when(F.col("s_suppkey") % 2 == 0, ".example.org").otherwise("")).alias("host"),
        F.concat(F.lit("fe80::"), F.lower(F.hex(F.col("s_suppkey") + 1)), F.lit("%eth0")).alias("addr"),
    )
    return report.mask_list(hosts).select("text")


def comment_rendering(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    comment = fn.render_comment(
        F.concat(F.lit("%i:%p %m | %d %i "), F.col("source")),
        F.concat(F.lit("10.0.0."), (F.col("doc_id") % 250).cast("string")),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")),
        F.col("text"),
        fn.format_epoch(F.col("doc_id") * 86461, "%Y/%m/%d %H:%M"),
    )
    return docs.select("doc_id", fn.truncate_comment(comment).alias("comment"), F.length(comment).alias("full_length"))


def payload(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cats = F.array(F.lit(14), (F.col("doc_id") % 20 + 3).cast("int"))
    ip = F.concat(F.lit("10.0.0."), (F.col("doc_id") % 250).cast("string"))
    return docs.select("doc_id", fn.report_payload(cats, "text", ip).alias("payload"))


# -- functions --------------------------------------------------------------------


def ip_version(spark, sf_dir):
    user = F.col("user_id")
    raw = F.when(user % 11 == 0, F.concat(F.lit("010."), demo.raw_ip(user))).when(
        user % 13 == 0, F.concat(demo.raw_ip(user), F.lit(":"))
    ).otherwise(demo.raw_ip(user))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), fn.ip_version(raw).alias("version"))


def ip6_format(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", demo.raw_ip(F.col("user_id")).alias("raw"))
    return lines.select("event_id", fn.ip6_format("raw").alias("canonical"), fn.normalize_ip("raw").alias("normal"))


def trim(spark, sf_dir):
    text = F.concat(F.lit(" \t"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")), F.lit("\r\n "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.trim_left(text).alias("left_done"), fn.trim_right(text).alias("right_done"),
        fn.to_lower(F.col("lang")).alias("lang"),
    )


def format_epoch(spark, sf_dir):
    seconds = fn.epoch_seconds("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", fn.format_epoch(seconds, "%Y-%m-%d %H:%M:%S").alias("standard"),
        fn.format_epoch(seconds, "%d/%m/%y at %H o'clock").alias("other"),
        fn.format_epoch(seconds, "%U %W %V %G %u %w %g %C").alias("weeks"),
        fn.format_epoch(seconds, "%e|%k|%l|%s|%P").alias("padded"), fn.format_epoch(seconds, "%x %X %Od").alias("composed"),
        fn.format_epoch(seconds, "%c").alias("whole"),
    )


def offset_times(spark, sf_dir):
    seconds, hours = fn.epoch_seconds("ts"), F.col("event_id") % 13
    sign = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    text = F.concat(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(hours.cast("string"), 2, "0"),
        F.lit(":30"),
    )
    return table(spark, sf_dir, "events").select("event_id", fn.parse_offset_ts(text).alias("seconds"))


def headers(spark, sf_dir):
    raw = F.concat(
        F.lit("HTTP/1.1 429 Too Many\r\nContent-Length: "), F.col("event_id").cast("string"),
        F.lit("\r\nReTry-After:  "), (F.col("event_id") % 900).cast("string"),
        F.lit(" \r\nX-Type: "), F.col("event_type"), F.lit("\r\nX-Type: again\r\n: none\r\n"),
    )
    parsed = fn.parse_headers(raw)
    return table(spark, sf_dir, "events").select(
        "event_id", F.size(parsed).alias("n"),
        fn.header_value(parsed, "retry-after").alias("retry_after"), parsed["X-Type"].alias("x_type"),
    )


def categories(spark, sf_dir):
    text = F.concat_ws(
        ",", (F.col("event_id") % 30).cast("string"),
        F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))),
        F.lit("22"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", fn.categories_csv(fn.parse_categories(text)).alias("parsed"),
    )


def scalar_parsers(spark, sf_dir):
    number = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("x"))
    )
    flag = F.when(F.col("event_id") % 4 == 0, "TRUE").when(F.col("event_id") % 4 == 1, "false").otherwise("maybe")
    return table(spark, sf_dir, "events").select(
        "event_id", fn.parse_uint(number).alias("number"), fn.parse_tristate(flag).alias("flag"),
        fn.clamp_feed_score(F.col("event_id") % 200).alias("feed_score"),
        fn.clamp_confidence(F.col("event_id") % 200).alias("confidence"),
        fn.sat_add_u32(F.lit(4294967000) + F.col("event_id"), F.col("user_id")).alias("sum_u32"),
    )


# -- files derived from the tables --------------------------------------------------


def state_lines(spark, sf_dir):
    """State file lines: an address per event (so addresses repeat), a feed row per
    customer, a bookmark per part, a removed line per supplier."""

    def pad(value, width):
        return F.lpad(value.cast("string"), width, " ")

    user, event = F.col("user_id"), F.col("event_id")
    flags = F.concat(
        F.when(user % 3 == 0, "y").otherwise("n"), F.when(user % 2 == 0, "y").otherwise("n")
    )
    tail = F.when(event % 3 == 0, F.concat(pad(event * 5, 20), F.when(user % 5 == 0, "6").otherwise("4"))).otherwise("")
    of_addresses = table(spark, sf_dir, "events").select(
        event.alias("seq"),
        F.concat(F.lit("d"), pad(demo.clean_ip(user), 39), pad(event * 100, 20), pad(event % 77, 10), pad(event % 55, 10),
                 pad(event % 33, 10), flags, tail).alias("line"),
    )
    cust = F.col("c_custkey")
    of_feed = table(spark, sf_dir, "customer").select(
        cust.alias("seq"),
        F.concat(F.lit("a"), pad(demo.clean_ip(cust % 1000), 39), pad(cust, 10), pad(cust % 101, 3)).alias("line"),
    )
    part = F.col("p_partkey")
    of_marks = table(spark, sf_dir, "part").select(
        part.alias("seq"),
        F.concat(F.lit("b"), pad(part * 10, 20), pad(part * 11, 20), F.lit("/var/log/"), F.col("p_brand"),
                 (part % 40).cast("string"), F.lit(" ")).alias("line"),
    )
    of_sync = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("s"), pad(F.col("o_orderkey"), 20), pad(F.col("o_orderkey") * 2, 20)).alias("line"),
    )
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.lit("r gone").alias("line"))
    return of_addresses.unionByName(of_feed).unionByName(of_marks).unionByName(of_sync).unionByName(gone)


def state_import(spark, sf_dir):
    return state_file.dedupe_rows(state_file.address_rows(state_lines(spark, sf_dir)))


def state_duplicates(spark, sf_dir):
    return state_file.duplicate_rows(state_file.address_rows(state_lines(spark, sf_dir)))


def feed_import(spark, sf_dir):
    return state_file.dedupe_rows(state_file.feed_rows(state_lines(spark, sf_dir)))


def bookmark_import(spark, sf_dir):
    return state_file.bookmark_rows(state_lines(spark, sf_dir))


def sync_import(spark, sf_dir):
    return state_file.feed_meta_row(state_lines(spark, sf_dir))


def state_load_report(spark, sf_dir):
    return state_file.state_load_report(state_lines(spark, sf_dir))


def config_lines(spark, sf_dir):
    """A config file per nation with one log group per supplier of that nation; each
    group has rules named after the supplier."""
    key = F.col("s_suppkey")
    name = F.replace("s_name", F.lit("#"), F.lit("-"))
    lines = F.array(
        F.concat(F.lit("[Log."), name, F.lit("]")),
        F.concat(F.lit("  log.path = /var/log/"), name),
        F.lit("# log.pattern = commented %i"),
        F.concat(F.lit("abuseipdb.report.categories = "), (key % 20 + 3).cast("string"), F.lit(", 22")),
        F.concat(F.lit("log.pattern = ^"), name, F.lit(" from %i port %p # note")),
        F.concat(F.lit("log.score = "), (key % 30).cast("string")),
        F.lit("log.pattern = no address here"),
        F.lit("log.abuseipdb.report = TRUE"),
        F.concat(F.lit("log.refused.pattern = "), name, F.lit(" %p SRC=%i")),
        F.when(key % 2 == 0, F.lit("log.refused.score = 5")).otherwise(F.lit("")),
        F.lit("log.abuseipdb.comment = %m"),
        F.lit("log.pattern = plain %i"),
    )
    groups = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("config"), key, F.posexplode(lines).alias("place", "line")
    ).select("config", (key * 100 + F.col("place") + 1000).alias("seq"), "line")
    top = F.array(
        F.lit("[Global]"),
        F.concat(F.lit("address.block.score = "), F.col("n_nationkey").cast("string")),
        F.concat(F.lit("abuseipdb.block.score = "), (F.col("n_nationkey") * 9).cast("string")),
        F.when(F.col("n_nationkey") % 2 == 0, "iptables.rules.block = -s %i -j LOG").otherwise("iptables.rules.block = x"),
    )
    heads = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("config"), F.posexplode(top).alias("place", "line")
    ).select("config", F.col("place").cast("bigint").alias("seq"), "line")
    return heads.unionByName(groups)


def rules_load(spark, sf_dir):
    loaded = config_file.load_rules(config_file.config_entries(config_lines(spark, sf_dir)))
    return loaded.withColumn("categories", fn.categories_csv("categories")).drop("group_idx").withColumn(
        "score", F.col("score").cast("bigint")
    )


def rules_compile(spark, sf_dir):
    loaded = config_file.load_rules(config_file.config_entries(config_lines(spark, sf_dir)))
    return rules.compile_rules(loaded).select("config", "log_group", "kind", "rule_idx", "port_pos", "ip_group", "regex")


def rules_rejected(spark, sf_dir):
    return config_file.rejected_patterns(config_file.config_entries(config_lines(spark, sf_dir)))


def groups_load(spark, sf_dir):
    loaded = config_file.load_groups(config_file.config_entries(config_lines(spark, sf_dir)))
    return loaded.select("config", "log_group", "group_idx", fn.categories_csv("categories").alias("categories"))


def files_load(spark, sf_dir):
    return config_file.load_files(config_file.config_entries(config_lines(spark, sf_dir)))


def settings_load(spark, sf_dir):
    loaded = config_file.load_globals(config_file.config_entries(config_lines(spark, sf_dir)))
    return loaded.select("config", "block_score", "multiplier", "feed_block_score", "rule_template", "reporting_enabled")


def _toggle_input(spark, sf_dir):
    commands = table(spark, sf_dir, "events").select(
        demo.clean_ip(F.col("user_id")).alias("ip"), (F.col("event_id") % 3 == 0).alias("confirmed"),
        F.col("event_id").alias("seq"),
    )
    return demo.kept_state(spark, sf_dir), commands


def toggle_blacklist(spark, sf_dir):
    return state.toggle_blacklist(*_toggle_input(spark, sf_dir), AS_OF).select("ip", "last_activity", "whitelisted", "blacklisted")


def toggle_whitelist(spark, sf_dir):
    return state.toggle_whitelist(*_toggle_input(spark, sf_dir), AS_OF).select("ip", "last_activity", "whitelisted", "blacklisted")


def remove_addresses(spark, sf_dir):
    ips = demo.feed(spark, sf_dir, True).select("ip")
    return state.remove_addresses(demo.kept_state(spark, sf_dir), ips)


def unknown_removals(spark, sf_dir):
    return state.unknown_removals(demo.kept_state(spark, sf_dir), demo.feed(spark, sf_dir, True))


def removal_plan(spark, sf_dir):
    parsed = firewall.parse_rules(demo.firewall_listing(spark, sf_dir), demo.TEMPLATE)
    return firewall.removal_plan(demo.feed(spark, sf_dir, True), parsed, SETTINGS)


def _marks(spark, sf_dir):
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(part % 3 != 0).select(
        F.concat(F.lit("/var/log/"), part.cast("string")).alias("path"), (part * 10).alias("bookmark"), (part * 11).alias("size")
    )


def _listing(spark, sf_dir):
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(part % 4 != 0).select(
        F.concat(F.lit("/var/log/"), part.cast("string")).alias("path"), (part * 9 + part % 5 * 1000).alias("length")
    )


def bookmarks_rotation(spark, sf_dir):
    return logs.detect_rotation(_listing(spark, sf_dir), _marks(spark, sf_dir))


def bookmarks_advance(spark, sf_dir):
    read = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/var/log/"), F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_orderkey") * 10).alias("end_offset"),
    )
    return logs.advance_bookmarks(_marks(spark, sf_dir), read, _listing(spark, sf_dir))


def bookmarks_reconcile(spark, sf_dir):
    return logs.reconcile_bookmarks(_listing(spark, sf_dir), _marks(spark, sf_dir))


def bookmarks_dropped(spark, sf_dir):
    return logs.dropped_bookmarks(_listing(spark, sf_dir), _marks(spark, sf_dir))


# -- saved responses -----------------------------------------------------------------


def feed_documents(spark, sf_dir):
    """One feed response per nation, with its customers as entries."""
    entry = F.struct(
        demo.clean_ip(F.col("c_custkey")).alias("ipAddress"),
        F.col("c_custkey").alias("totalReports"),
        (F.col("c_custkey") % 101).cast("string").alias("abuseConfidenceScore"),
    )
    body = F.to_json(F.struct(
        F.struct(F.concat(F.lit("2019-05-20T17:00:"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("+01:00")).alias("generatedAt")).alias("meta"),
        F.col("data"),
    ))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.sort_array(F.collect_list(entry)).alias("data")
    ).select(body.alias("body"))


def feed_read(spark, sf_dir):
    return reputation.parse_feed(feed_documents(spark, sf_dir), 75)


def feed_read_time(spark, sf_dir):
    return reputation.parse_feed_time(feed_documents(spark, sf_dir))


def check_documents(spark, sf_dir):
    key = F.col("c_custkey")
    when = F.concat(F.lit("2019-05-20T17:00:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit("+01:00"))
    past = F.struct(
        when.alias("reportedAt"), F.col("c_name").alias("comment"),
        F.array(F.lit(18), (key % 20 + 3).cast("int")).alias("categories"), key.alias("reporterId"),
        F.lit("LV").alias("reporterCountryCode"), F.lit("Latvia").alias("reporterCountryName"),
    )
    data = F.struct(
        demo.clean_ip(key).alias("ipAddress"), (key % 2 == 0).alias("isPublic"), F.lit(4).alias("ipVersion"),
        (key % 3 == 0).alias("isWhitelisted"), (key % 101).cast("int").alias("abuseConfidenceScore"),
        F.lit("LV").alias("countryCode"), F.lit("Latvia").alias("countryName"), key.alias("totalReports"),
        F.when(key % 5 != 0, when).alias("lastReportedAt"),
        F.when(key % 4 == 0, F.array(past, past)).otherwise(F.array()).alias("reports"),
    )
    return table(spark, sf_dir, "customer").select(F.to_json(F.struct(data.alias("data"))).alias("body"))


def checks_read(spark, sf_dir):
    return reputation.parse_checks(check_documents(spark, sf_dir))


def check_reports(spark, sf_dir):
    flat = reputation.check_reports(reputation.parse_checks(check_documents(spark, sf_dir), verbose=True))
    return flat.withColumn("categories", fn.categories_csv("categories"))


def report_responses(spark, sf_dir):
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, 429).when(key % 5 == 1, 500).otherwise(200)
    detail = F.concat(F.lit("order "), key.cast("string"))
    body = (
        F.when(key % 5 == 4, F.lit("no json"))
        .when((key % 5 == 3) | (key % 5 == 0), F.to_json(F.struct(F.array(F.struct(detail.alias("detail"))).alias("errors"))))
        .otherwise(F.to_json(F.struct(F.struct(detail.alias("ipAddress")).alias("data"))))
    )
    raw = table(spark, sf_dir, "orders").select(
        key, status.alias("status"), F.concat(F.lit("Retry-After: "), (key % 900).cast("string")).alias("headers"), body.alias("body")
    )
    return reputation.parse_report_responses(raw).select(
        "o_orderkey", "outcome", F.array_join("errors", ";").alias("errors"), "retry_after"
    )


def _folder(spark, name):
    """A folder of its own in the shared one, removed with the staged tables."""
    return adopt(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _log_files(spark, sf_dir):
    """The lines as text files, a folder of them for one group and names that a glob fits for
    the other, beside files that it does not fit; and the configuration that names both."""
    folder, lines = _folder(spark, "logs"), written(demo.log_lines(spark, sf_dir))
    for group in demo.GROUPS:
        lines.filter(F.col("log_group") == group).select("line").write.option("lineSep", "\n").text(f"{folder}/{group}")
    lines.limit(1).select("line").write.text(f"{folder}/other")
    entries = [("OpenSSH", 0, 0, f"{folder}/OpenSSH"), ("ApacheAccess", 1, 0, f"{folder}/Apache*/part-*.t[x]{{t,u}}"), ("OpenSSH", 0, 1, f"{folder}/none")]
    return spark.createDataFrame(entries, schemas.FILES)


def scan_files(spark, sf_dir):
    """Every line of a folder and of a glob."""
    return logs.scan_logs(spark, _log_files(spark, sf_dir), F.lit(7).cast("bigint")).select("log_group", "group_idx", "ts", "line")


def tail_files(spark, sf_dir):
    """Each file up to a line near its middle, then on from the bookmark left there."""
    files, ts = _log_files(spark, sf_dir), F.lit(7).cast("bigint")
    nothing = spark.createDataFrame([], schemas.BOOKMARKS)
    first = written(tail.tail_logs(spark, files, nothing, ts))
    sizes = logs.list_logs(spark, files).select("path", F.col("length").alias("size"))
    marks = first.join(sizes, "path").filter(F.col("end_offset") * 2 <= F.col("size")).groupBy("path", "size").agg(
        F.max("end_offset").alias("bookmark")
    ).select("path", "bookmark", "size")
    marks = written(marks)
    before = first.join(marks, "path").filter(F.col("end_offset") <= F.col("bookmark"))
    after = tail.tail_logs(spark, files, marks, ts)
    columns = ["log_group", "group_idx", "ts", "line"]
    return before.select(*columns).unionByName(after.select(*columns))


def outbox_files(spark, sf_dir):
    """Reports put out in two batches, the second of them twice, and read back."""
    folder = _folder(spark, "outbox")
    reports = written(report.render_reports(emitted(spark, sf_dir), SETTINGS))
    for batch in (0, 1, 1):
        sinks.write_report_outbox(reports.filter(F.col("ts") % 2 == batch), folder, batch)
    return spark.read.schema(schemas.REPORTS).parquet(folder).select("ip", "ts", "comment")


def plan_files(spark, sf_dir):
    """Commands of a plan, written as text and read back."""
    folder = _folder(spark, "plan")
    sinks.write_firewall_plan(firewall_plan(spark, sf_dir), folder)
    return spark.read.text(folder).select(F.col("value").alias("command"))


def listing_files(spark, sf_dir):
    """Listings of both address families as text files, read back as one."""
    folder, listing = _folder(spark, "listing"), written(demo.firewall_listing(spark, sf_dir))
    for version in (4, 6):
        listing.filter(F.col("ip_version") == version).select("line").write.text(f"{folder}/v{version}")
    return read_firewall_rules(spark, f"{folder}/v4", f"{folder}/v6").select("ip_version", "line")


# -- streaming -----------------------------------------------------------------------


def monitor_state(spark, sf_dir):
    """The monitor follows the events as a stream; its state ends up as in a batch."""
    folder = _folder(spark, "monitor")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    config = partial(log_check.Config, groups=demo_groups(spark), settings=SETTINGS)
    monitor = Monitor(folder, lambda session: config(demo_rules(session)))
    monitor.start(demo.lines_dealt_out(events)).awaitTermination()
    return monitor.state(spark).select("ip", "last_activity", "score", "activity_count", "refused_count")


def _quiet_monitor(spark, sf_dir, **given):
    """A monitor that has read all events, with rules at the time of the last of them."""
    folder = _folder(spark, "monitor")
    config = partial(log_check.Config, groups=demo_groups(spark))
    box = {"settings": SETTINGS}
    monitor = Monitor(folder, lambda session: config(demo_rules(session), settings=box["settings"]), **given)
    monitor.check(demo.log_lines(spark, sf_dir), 0)
    return monitor, box


def monitor_expiry(spark, sf_dir):
    """No more lines come, and all blocks run out."""
    monitor, _ = _quiet_monitor(spark, sf_dir)
    monitor.tick(spark, AS_OF + 10**8)
    return monitor.commands(spark).select("ip", "action")


def monitor_feed_sync(spark, sf_dir):
    """A feed is fetched once it is due, a failure is made good 300 seconds later."""
    calls = []

    def fetch(session):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("service not reached")
        return demo.feed(session, sf_dir, False)

    monitor, box = _quiet_monitor(spark, sf_dir, fetch=fetch)
    box["settings"] = replace(SETTINGS, feed_interval=86400)
    for late in (0, 200, 300, 400):
        monitor.tick(spark, AS_OF + 10**8 + late)
    ruled = monitor._feed(spark).select("ip", "confidence", "has_rule")
    return ruled.withColumn("fetches", F.lit(len(calls)))


def monitor_template(spark, sf_dir):
    """The rule template changes while rules are set."""
    monitor, box = _quiet_monitor(spark, sf_dir)
    monitor.tick(spark, AS_OF - 10**7)
    box["settings"] = replace(SETTINGS, rule_template="-s %i -j REJECT")
    monitor.tick(spark, AS_OF - 10**7)
    return monitor.commands(spark).select("ip", "action", "command")


def _followed(spark, sf_dir):
    """A monitor that has followed ten files of events in order of time, one for each batch,
    with a new start of the stream in the middle."""
    folder = _folder(spark, "events")
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    place = F.least(F.floor((fn.epoch_seconds("ts") - int(low.timestamp())) * 10 / (int(high.timestamp()) - int(low.timestamp()) + 1)), F.lit(9))
    sliced = f"{folder}/sliced"  # by slice, so each of the ten files is made of its own rows only
    events.withColumn("slice", place.cast("int")).write.partitionBy("slice").parquet(sliced)
    by_slice = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, slice int").parquet(sliced)
    config = partial(log_check.Config, groups=demo_groups(spark), settings=SETTINGS)
    monitor = Monitor(f"{folder}/monitor", lambda session: config(demo_rules(session)))
    for half in (range(5), range(5, 10)):
        for k in half:
            by_slice.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        monitor.start(demo.lines_dealt_out(stream)).awaitTermination()
    return monitor


def stream_equals_batch(spark, sf_dir):
    """The state of a stream ends up as in one batch."""
    return _followed(spark, sf_dir).state(spark).select("ip", "last_activity", "score", "activity_count", "refused_count")


def stream_reports(spark, sf_dir):
    """Scores of a stream beside its reports: the last of each address, as the state has it, and
    how many were put out."""
    monitor = _followed(spark, sf_dir)
    out = monitor.reports(spark).groupBy("ip").agg(F.count("*").alias("reports"), F.max("ts").alias("newest"))
    return monitor.state(spark).join(out, "ip", "left").select("ip", "score", "last_reported", "reports", "newest")


def two_writers(spark, sf_dir):
    """Two monitors on one folder, each with the lines of every other address, at the same time:
    nothing that either writes is lost."""
    folder = _folder(spark, "monitor")
    config = partial(log_check.Config, groups=demo_groups(spark), settings=SETTINGS)
    lines = written(demo.log_lines(spark, sf_dir))
    half = F.pmod(F.xxhash64(F.regexp_extract("line", r"(?:SRC=|from |FROM |^)([0-9A-F:.]{7,})", 1)), F.lit(2))
    monitors = [Monitor(folder, lambda session: config(demo_rules(session)), name=name) for name in ("one", "two")]
    middle = lines.select(F.percentile_approx("ts", 0.5)).first()[0]

    def follow(k):
        mine = lines.filter(half == k)
        monitors[k].check(mine.filter(F.col("ts") < middle), 0)
        monitors[k].check(mine.filter(F.col("ts") >= middle), 1)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(follow, range(2)))
    return monitors[0].state(spark).select("ip", "last_activity", "score", "activity_count", "refused_count")


def monitor_reconcile(spark, sf_dir):
    """At a start, the firewall lists rules of its own: every third user, due or not, and
    addresses that nothing is known of."""
    monitor, _ = _quiet_monitor(spark, sf_dir, listing=lambda session: demo.firewall_listing(session, sf_dir))
    monitor.reconcile(spark, AS_OF)
    return monitor.state(spark).select("ip", "has_rule")


def report_delivery(spark, sf_dir):
    """Reports go out in three batches in order of time; some answers order a pause of an hour;
    the first batch comes once more."""
    folder = _folder(spark, "delivery")
    reports = written(report.render_reports(emitted(spark, sf_dir), SETTINGS))
    low, high = table(spark, sf_dir, "events").agg(fn.epoch_seconds(F.min("ts")), fn.epoch_seconds(F.max("ts"))).first()
    place = F.floor((F.col("ts") - low) * 3 / (high - low + 1))

    def send(rows):
        busy = F.col("ts") % 50 == 0
        return rows.select(
            "ip", "ts", F.when(busy, 429).otherwise(200).alias("status"), F.when(busy, "Retry-After: 3600").otherwise("").alias("headers"),
            F.when(busy, "").otherwise('{"data": {"ipAddress": "x"}}').alias("body"),
        )

    delivery = Delivery(folder, send)
    for batch, k in enumerate((0, 1, 2, 0)):
        for _ in range(2):  # the second time it is there already
            delivery.deliver(reports.filter(place == k), batch)
    return delivery.outcomes(spark).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("ip", "ts").alias("reports"))


QUERIES = {
    f.__name__: f
    for f in (
        match_first_rule, match_refused, known_refused, unknown_refused, attach_state,
        decayed_score, growing_score, state_after, state_update, activity_by_address, expiry, saturated_state,
        block_episodes, block_starts, blocked_now, status_label,
        firewall_plan, firewall_plan_without_decay, state_after_plan, parse_firewall_rules, unknown_rules,
        template_migration, sync_rule_flag,
        summary, top_active, last_active, list_blocked, list_all,
        feed_diff, feed_counts, feed_apply, feed_except, feed_save, feed_generation, feed_sync_due, feed_plan,
        report_settings, throttle, rendered_reports, last_reported, rate_limited, category_names,
        mask_text, mask_list, comment_rendering, payload,
        ip_version, ip6_format, trim, format_epoch, offset_times, headers, categories, scalar_parsers,
        state_import, state_duplicates, feed_import, bookmark_import, sync_import, state_load_report,
        match_escapes, match_posix, match_long_list, rule_problems, repeated_groups,
        rules_load, rules_compile, rules_rejected, groups_load, files_load, settings_load,
        toggle_blacklist, toggle_whitelist, remove_addresses, unknown_removals, removal_plan,
        bookmarks_rotation, bookmarks_advance, bookmarks_reconcile, bookmarks_dropped,
        feed_read, feed_read_time, checks_read, check_reports, report_responses,
        monitor_state, monitor_expiry, monitor_feed_sync, monitor_template, stream_equals_batch, stream_reports, two_writers, monitor_reconcile, report_delivery, scan_files, tail_files, outbox_files, plan_files, listing_files,
    )
}
