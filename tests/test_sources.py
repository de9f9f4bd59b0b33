import json

from pyspark.sql import functions as F

from logwarden import Settings
from logwarden.operators import rules as rl
from logwarden.schemas import BOOKMARKS, FILES
from logwarden.sources import config_file as cf
from logwarden.sources import firewall_rules, logs, reputation, snapshot, tail
from logwarden.sources import state_file as sf

CONFIG = r"""
# comment
[Global]
log.level = INFO
address.block.score = 12 # inline
address.block.multiplier=0
iptables.rules.block = no placeholder
iptables.rules.pos = TAIL
abuseipdb.block.score = 400
abuseipdb.report.categories = 4,5,x
abuseipdb.report.comment =
abuseipdb.api.key = k
[Log.SSH]
log.score = 99
abuseipdb.report.all = true
abuseipdb.report.categories = 18,22
log.path = /var/log/a
log.path = /var/log/b
log.pattern = ^x sshd\[\d+\]: from %i$
log.score = 7
log.abuseipdb.report = false
log.pattern = no address
log.abuseipdb.comment = %m here
log.refused.pattern = SRC=%i DPT=%p.*
log.refused.score = 5
log.abuseipdb.categories = 14
log.abuseipdb.categories = 15,16
log.pattern = port %p from %i
[Log.Web]
log.score = 3
log.pattern = %i (GET|HEAD) .*
"""


def entries(spark, tmp_path, text=CONFIG):
    path = tmp_path / "my rules.conf"
    path.write_text(text)
    return cf.config_entries(cf.read_config(spark, str(path)))


def test_rules_file(spark, tmp_path):
    e = entries(spark, tmp_path).cache()
    rules = [tuple(r)[1:] for r in cf.load_rules(e).orderBy("group_idx", "kind", "rule_idx").collect()]
    assert rules == [
        ("SSH", 0, "activity", 0, r"^x sshd\[\d+\]: from %i$", 7, False, [], "%m here"),
        ("SSH", 0, "activity", 1, "port %p from %i", 1, None, [], None),
        ("SSH", 0, "refused", 0, "SRC=%i DPT=%p.*", 5, None, [14, 15, 16], None),
        ("Web", 1, "activity", 0, "%i (GET|HEAD) .*", 1, None, [], None),
    ]
    assert [r["pattern"] for r in cf.rejected_patterns(e).collect()] == ["no address"]
    groups = [tuple(r)[1:] for r in cf.load_groups(e).orderBy("group_idx").collect()]
    assert groups == [("SSH", 0, True, [18, 22], None), ("Web", 1, None, [], None)]
    files = [tuple(r)[1:] for r in cf.load_files(e).orderBy("file_idx").collect()]
    assert files == [("SSH", 0, 0, "/var/log/a"), ("SSH", 0, 1, "/var/log/b")]
    assert cf.load_settings(e) == Settings(
        block_score=12, multiplier=0, feed_block_score=100, default_categories=(4, 5), default_comment="",
        append_rules=True)


def test_empty_config_gives_defaults(spark, tmp_path):
    assert cf.load_settings(entries(spark, tmp_path, "[Global]\nlog.level = INFO\n")) == Settings(reporting_enabled=False)


def test_compile_and_resolve(spark, tmp_path):
    e = entries(spark, tmp_path)
    rules, groups = cf.load_rules(e).drop("config"), cf.load_groups(e).drop("config")
    got = {(r["log_group"], r["kind"], r["rule_idx"]): r for r in rl.compile_rules(rules).collect()}
    assert (got["SSH", "activity", 1]["port_pos"], got["SSH", "activity", 1]["ip_group"]) == (2, 2)
    assert got["SSH", "refused", 0]["port_pos"] == 1
    assert got["Web", "activity", 0]["port_pos"] == -1 and got["Web", "activity", 0]["ip_group"] == 1
    resolved = {(r["log_group"], r["kind"], r["rule_idx"]): (r["report"], r["categories"], r["comment"])
                for r in rl.resolve_report_settings(rules, groups, Settings(default_comment="d")).collect()}
    assert resolved == {
        ("SSH", "activity", 0): (False, [18, 22], "%m here"),
        ("SSH", "activity", 1): (True, [18, 22], "d"),
        ("SSH", "refused", 0): (True, [14, 15, 16], "d"),
        ("Web", "activity", 0): (False, [15], "d"),
    }
    broken = rules.withColumn("pattern", F.lit("(%i")).limit(1)
    assert rl.rule_problems(broken).first()["error"] == "pattern does not compile"
    assert "Unclosed group" in rl.compile_error(spark, rl.compile_rules(broken).first()["regex"])


def d_line(ip, la, score, act, ref, flags, reported=None, version=None):
    line = f"d{ip:>39}{la:>20}{score:>10}{act:>10}{ref:>10}{flags}"
    if reported is not None:
        line += f"{reported:>20}"
    return line + (version or "")


STATE_LINES = [
    d_line("192.0.2.44", 1650000123, 0, 1, 0, "nn"),
    d_line("192.0.2.45", 1660000456, 90210, 321, 4, "yy", 77, "4"),
    d_line("2001:db8::1", 5, 4294967295, 1, 1, "ny", 9, " "),
    d_line("192.0.2.44", 1, 2, 3, 4, "yn", 5, "4"),
    f"b{4096:>20}{4096:>20}/var/log/auth.log ",
    f"b{7:>20}{9:>20}/var/log/other.log",
    f"a{'1.2.3.4':>39}{12:>10}{95:>3}4",
    f"a{'1.2.3.4':>39}{13:>10}{96:>3}",
    f"s{100:>20}{90:>20}",
    "r anything",
    "r" + " " * 60,
]


def test_state_file(spark, tmp_path):
    path = tmp_path / "state.data"
    path.write_text("\n".join(STATE_LINES))
    lines = sf.read_state(spark, str(path))
    rows = sf.address_rows(lines)
    got = sorted(map(tuple, sf.dedupe_rows(rows).collect()))
    assert got == [
        ("192.0.2.44", 1650000123, 0, 1, 0, False, False, 0, 4, False),
        ("192.0.2.45", 1660000456, 90210, 321, 4, True, False, 77, 4, False),
        ("2001:db8::1", 5, 4294967295, 1, 1, False, True, 9, 6, False),
    ]
    assert [tuple(r) for r in sf.duplicate_rows(rows).collect()] == [("192.0.2.44", 2)]
    assert sorted(map(tuple, sf.bookmark_rows(lines).collect())) == [
        ("/var/log/auth.log", 4096, 4096), ("/var/log/other.log", 7, 9)]
    assert [tuple(r) for r in sf.dedupe_rows(sf.feed_rows(lines)).collect()] == [("1.2.3.4", 12, 95, 4, False)]
    assert tuple(sf.feed_meta_row(lines).first()) == (100, 90)
    assert tuple(sf.state_load_report(lines).first()) == (3, 1, 2, 2, True, True)


def test_bookmarks(spark):
    files = spark.createDataFrame([("G", 0, 0, "/a"), ("G", 0, 1, "/new")], FILES)
    marks = spark.createDataFrame([("/a", 100, 100), ("/gone", 5, 5)], BOOKMARKS)
    assert sorted(map(tuple, logs.reconcile_bookmarks(files, marks).collect())) == [("/a", 100, 100), ("/new", 0, 0)]
    assert [r["path"] for r in logs.dropped_bookmarks(files, marks).collect()] == ["/gone"]
    listing = spark.createDataFrame([("/a", 40), ("/gone", 9)], "path string, length long")
    assert sorted(map(tuple, logs.detect_rotation(listing, marks).collect())) == [("/a", 0, 100, True), ("/gone", 5, 5, False)]
    lines = spark.createDataFrame([("/a", 130), ("/a", 120)], "path string, end_offset long")
    assert sorted(map(tuple, logs.advance_bookmarks(marks, lines, listing).collect())) == [
        ("/a", 130, 40, True), ("/gone", 5, 9, False)]


def test_scan_keeps_order_and_skips_missing_files(spark, tmp_path):
    first, second = tmp_path / "b log+1.txt", tmp_path / "a.txt"
    first.write_bytes(b"one\r\ntwo\n")
    second.write_bytes(b"three")
    files = spark.createDataFrame([("G", 0, 0, str(first)), ("G", 0, 1, str(second)), ("H", 1, 0, "/no/such/file")], FILES)
    got = logs.scan_logs(spark, files, F.lit(5).cast("long")).orderBy("seq").collect()
    assert [(r["line"], r["ts"], r["log_group"]) for r in got] == [("one\r", 5, "G"), ("two", 5, "G"), ("three", 5, "G")]
    assert [r["path"] for r in logs.missing_files(spark, files).collect()] == ["/no/such/file"]


def test_tail_reads_only_new_whole_lines(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.log"
    lines = [("line %d " % i) + "x" * (i * 7 % 50) for i in range(300)]
    text = "\n".join(lines) + "\nunfinished"
    path.write_text(text)
    files = spark.createDataFrame([("G", 0, 0, str(path))], FILES)
    start = len("\n".join(lines[:10])) + 1
    marks = spark.createDataFrame([(str(path), start, start)], BOOKMARKS)
    got = tail.tail_logs(spark, files, marks, F.lit(1)).orderBy("seq").collect()
    assert [r["line"] for r in got] == lines[10:]
    assert got[0]["byte_offset"] == start and got[-1]["end_offset"] == len(text) - len("unfinished")
    rotated = spark.createDataFrame([(str(path), start, 10**6)], BOOKMARKS)
    assert tail.tail_logs(spark, files, rotated, F.lit(1)).count() == 300


def test_byte_ranges_cut_anywhere(tmp_path, monkeypatch):
    path = tmp_path / "y.log"
    data = b"".join(b"%d\xff" % i + b"y" * (i % 13) + b"\n" for i in range(200)) + b"\n\ntail"
    path.write_bytes(data)
    limit = tail.end_of_last_line(str(path), 0, len(data), 5)
    assert limit == len(data) - 4
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(tail, "RANGE_BYTES", size)
        monkeypatch.setattr(tail, "BLOCK_BYTES", max(3, size // 2))
        got = []
        for part in tail.byte_ranges(str(path), 0, limit):
            for batch in tail.read_range(part):
                got += batch.to_pylist()
        assert b"".join(data[g["byte_offset"]:g["end_offset"]] for g in got) == data[:limit]
        assert len(got) == 202


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert snapshot.current_version(spark, folder) is None
    for version in (1, 2):
        snapshot.write_state(folder, version, state=spark.range(version))
    assert snapshot.current_version(spark, folder) == 2
    assert snapshot.current_version(spark, folder, before=2) == 1
    assert snapshot.load_table(spark, folder, 2, "state").count() == 2


def test_reputation_responses(spark, tmp_path):
    feed = {"meta": {"generatedAt": "2019-05-20T17:00:02+01:00"},
            "data": [{"ipAddress": "1.1.1.1", "totalReports": 3, "abuseConfidenceScore": "100"},
                     {"ipAddress": "2001:db8::1", "totalReports": 4, "abuseConfidenceScore": 91},
                     {"ipAddress": "1.1.1.1", "totalReports": 9, "abuseConfidenceScore": 99},
                     {"ipAddress": "3.3.3.3", "totalReports": 9, "abuseConfidenceScore": 10}]}
    path = tmp_path / "feed.json"
    path.write_text(json.dumps(feed, indent=1))
    assert sorted(map(tuple, reputation.read_feed(spark, str(path), 90).collect())) == [
        ("1.1.1.1", 3, 100, 4, False), ("2001:db8::1", 4, 91, 6, False)]
    assert reputation.parse_feed_time(reputation.read_documents(spark, str(path))).first()[0] == 1558368002
    check = {"data": {"ipAddress": "1.1.1.1", "isPublic": True, "ipVersion": 4, "isWhitelisted": None,
                      "abuseConfidenceScore": 7, "countryCode": "LV", "countryName": "Latvia", "totalReports": 1,
                      "lastReportedAt": "2019-05-20T17:00:02+01:00",
                      "reports": [{"reportedAt": "2019-05-20T17:00:02+01:00", "comment": "c", "categories": [18, 22],
                                   "reporterId": 1, "reporterCountryCode": "LV", "reporterCountryName": "Latvia"}]}}
    path = tmp_path / "check.json"
    path.write_text(json.dumps(check))
    checks = reputation.read_checks(spark, str(path), verbose=True)
    row = checks.first()
    assert (row["is_public"], row["is_whitelisted"], row["last_reported_at"], row["country_name"]) == (True, False, 1558371602, "Latvia")
    assert tuple(reputation.check_reports(checks).first())[:4] == ("1.1.1.1", 1558371602, "c", [18, 22])
    responses = spark.createDataFrame(
        [(200, "", '{"data": {"ipAddress": "1.1.1.1"}}'), (200, "", '{"errors": [{"detail": "bad"}]}'), (200, "", "nonsense"),
         (429, "Retry-After: 60\r\n", '{"errors": [{"detail": "limit"}]}'), (500, "Retry-After: 60", "")],
        "status int, headers string, body string")
    got = [(r["outcome"], r["errors"], r["retry_after"]) for r in reputation.parse_report_responses(responses).collect()]
    assert got == [("ok", [], 0), ("rejected", ["bad"], 0), ("unreadable", [], 0), ("failed", ["limit"], 60), ("failed", [], 0)]


def test_firewall_listing(spark, tmp_path):
    for name, line in (("v4", "-A INPUT -s 1.1.1.1/32 -j DROP"), ("v6", "-A INPUT -s ::1/128 -j DROP")):
        (tmp_path / name).write_text("-P INPUT ACCEPT\n" + line + "\n")
    got = firewall_rules.read_firewall_rules(spark, str(tmp_path / "v4"), str(tmp_path / "v6"))
    assert got.filter("ip_version = 6").count() == 2
