from pyspark.sql import functions as F

from logwarden import Settings, rulesets, schemas
from logwarden.operators import known, match, report, rules, score, state
from logwarden.plans import demo
from logwarden.plans.log_check import Config, sync_feed
from logwarden.sources.tail import tail_stream
from logwarden.streaming import store
from logwarden.streaming.monitor import Monitor, template_change
from tests.test_score import HITS, make_hits

SETTINGS = Settings(report_all=True)


def config(spark):
    r = rulesets.builtin_rules(spark, demo.GROUPS)
    return Config(r, spark.createDataFrame([], schemas.GROUPS), SETTINGS)


def batch_result(spark, lines):
    hits = known.known_refused(match.match_rules(lines, rulesets.builtin_rules(spark, demo.GROUPS)))
    after = state.state_from_hits(hits, SETTINGS.multiplier)
    resolved = rules.resolve_report_settings(config(spark).rules, config(spark).groups, SETTINGS)
    asked = report.reportable(report.report_settings(hits, resolved), SETTINGS)
    return after, report.throttle_reports(asked, after)


def test_monitor_over_time_slices_equals_one_batch(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FULL_EVERY", 3)
    lines = demo.log_lines(spark, sf_dir).cache()
    bounds = lines.select(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    cuts = [0, *bounds, 1 << 40]
    monitor = Monitor(str(tmp_path / "run"), config)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = lines.filter((F.col("ts") >= a) & (F.col("ts") < b))
        monitor.check(part, n)
        if n == 1:
            monitor.check(part, n)
    after, emitted = batch_result(spark, lines)
    columns = ["ip", "last_activity", "score", "activity_count", "refused_count"]
    got = {tuple(r) for r in monitor.state(spark).select(*columns).collect()}
    assert got == {tuple(r) for r in after.select(*columns).collect()}
    reports = {(r["ip"], r["ts"]) for r in monitor.reports(spark).collect()}
    assert reports == {(r["ip"], r["ts"]) for r in emitted.collect()}
    newest = monitor.reports(spark).groupBy("ip").agg(F.max("ts")).collect()
    assert {r["ip"]: r["last_reported"] for r in monitor.state(spark).collect() if r["last_reported"]} == dict(map(tuple, newest))
    commands = [r["action"] for r in monitor.commands(spark).collect()]
    ruled = monitor.state(spark).filter("has_rule").count()
    assert commands.count("ADD") - commands.count("REMOVE") == ruled and commands.count("ADD") > 0


def test_monitor_follows_files(spark, tmp_path):
    log = tmp_path / "auth.log"
    log.write_text("Jun  2 11:25:00 h sshd[1]: Invalid user admin from 10.10.10.10\n"
                   "Jun  2 11:25:00 h sshd[1]: ROOT LOGIN REFUSED FROM 10.10.10.10\nJun  2 11:25:00 h sshd[1]: ROOT LOG")
    files = spark.createDataFrame([("OpenSSH", 0, 0, str(log))], schemas.FILES)
    marks = spark.createDataFrame([], schemas.BOOKMARKS)
    monitor = Monitor(str(tmp_path / "run"), config)

    def run(now):
        lines = tail_stream(spark, files, marks, F.lit(now).cast("bigint"))
        monitor.start(lines.select("log_group", "seq", "ts", "line")).awaitTermination()
        return {r["ip"]: (r["score"], r["activity_count"], r["has_rule"]) for r in monitor.state(spark).collect()}

    assert run(1000) == {"10.10.10.10": (79200, 2, True)}
    with log.open("a") as f:
        f.write("IN REFUSED FROM 10.10.10.11\n")
    assert run(1100) == {"10.10.10.10": (79200, 2, True), "10.10.10.11": (72000, 1, True)}
    log.write_text("Jun  2 11:25:00 h sshd[1]: Invalid user b from 10.10.10.12 port 7\n")
    after = run(90000)
    assert after == {"10.10.10.10": (79200, 2, False), "10.10.10.11": (72000, 1, False), "10.10.10.12": (7200, 1, False)}
    assert {r["command"] for r in monitor.commands(spark).filter("action = 'REMOVE'").collect()} == {
        "iptables -D INPUT -s 10.10.10.10 -j DROP", "iptables -D INPUT -s 10.10.10.11 -j DROP"}


def test_feed_sync_plan(spark):
    old = spark.createDataFrame([("1.1.1.1", 1, 95, 4, True), ("2.2.2.2", 1, 95, 4, True)], schemas.FEED)
    new = spark.createDataFrame([("2.2.2.2", 2, 96, 4, False), ("3.3.3.3", 2, 97, 4, False), ("4.4.4.4", 1, 80, 4, False)], schemas.FEED)
    after, plan, counts = sync_feed(old, new, store.empty_state(spark), SETTINGS, 1000)
    assert {r["ip"]: r["has_rule"] for r in after.collect()} == {"2.2.2.2": True, "3.3.3.3": True, "4.4.4.4": False}
    assert {(r["ip"], r["action"]) for r in plan.collect()} == {("1.1.1.1", "REMOVE"), ("3.3.3.3", "ADD")}
    assert {r["action"]: r["n"] for r in counts.collect()} == {"new": 2, "updated": 1, "removed": 1}
    assert template_change(plan, SETTINGS, SETTINGS) is None


def test_per_second_totals_are_enough_for_the_state(spark):
    hits = spark.createDataFrame(make_hits(4, 100), HITS)
    assert score.per_second(hits, 1).agg(F.sum("activity") + F.sum("refused")).first()[0] == 100


def test_lines_of_one_file_are_dealt_out(spark, sf_dir, tmp_path):
    """A batch of one file that cannot be split is matched by all cores, and hits are many files."""
    demo.table(spark, sf_dir, "events").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(demo.table(spark, sf_dir, "events").schema).parquet(str(tmp_path / "in"))
    parts = []
    stream = demo.lines_dealt_out(events).writeStream.foreachBatch(lambda lines, _: parts.append(lines.rdd.getNumPartitions()))
    stream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert parts == [spark.sparkContext.defaultParallelism]


def test_what_is_known_is_looked_up_only_if_there_is_something(spark):
    """Without a stored state the fold has no join by address, and gives what `state_from_hits` does."""
    hits = spark.createDataFrame(make_hits(4, 100), HITS)
    fresh = state.changed_rows(store.empty_state(spark), hits, 3600)
    assert {tuple(r) for r in fresh.collect()} == {tuple(r) for r in state.state_from_hits(hits, 3600).collect()}
    assert "salt" not in fresh._jdf.queryExecution().optimizedPlan().toString()
