import random

import pytest

from logwarden import Settings
from logwarden.operators import block as bl
from logwarden.operators import feed as fd
from logwarden.operators import firewall as fw
from logwarden.operators import known as kn
from logwarden.operators import score as sc
from logwarden.operators import stats
from logwarden.schemas import FEED, FEED_META, STATE
from tests.test_score import HITS, fold, make_hits


def simulate(rows, settings):
    """Second by second: create a rule by the score, take it away when it has run out."""
    out = []
    for ip in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == ip)
        blocked, la, s, start = False, None, 0, None
        for t in range(mine[0][1], mine[-1][1] + 500000):
            if blocked and t > la + s:
                out.append((ip, start, la + s))
                blocked = False
            for r in [r for r in mine if r[1] == t]:
                s = max(0, s - (t - la)) if la is not None else 0
                s, la = s + r[4] * settings.multiplier, t
            if la is None:
                continue
            if not blocked and s > 0 and t < la + s - settings.block_threshold:
                blocked, start = True, t
            if not blocked and t > mine[-1][1] and t > la + s:
                break
    return sorted(out)


def test_episodes_equal_a_simulation(spark, monkeypatch):
    monkeypatch.setattr(sc, "CHUNK_SECONDS", 700)
    settings = Settings(block_score=3, multiplier=50)
    rng = random.Random(9)
    rows = [(f"ip{i}", rng.randint(0, 6000), i * 100 + k, "activity", rng.choice([0, 1, 1, 2, 5]))
            for i in range(12) for k in range(rng.choice([3, 20, 60]))]
    steps = sc.per_second(spark.createDataFrame(rows, HITS), settings.multiplier)
    got = sorted(tuple(r) for r in bl.block_episodes(steps, settings).collect())
    assert got == simulate(rows, settings)
    assert len(got) > 20


def test_episodes_without_decay_never_end(spark):
    settings = Settings(block_score=3, multiplier=0)
    rows = [("a", 10, 1, "activity", 2), ("a", 20, 2, "activity", 2), ("b", 5, 3, "activity", 3)]
    steps = sc.per_second(spark.createDataFrame(rows, HITS), 0)
    assert [tuple(r) for r in bl.block_episodes(steps, settings).collect()] == [("a", 20, None)]


def test_known_refused(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = make_hits(1, 300, ips=20) + [("10.0.0.1", rng.randint(0, 99), 1000 + i, "refused", 5) for i in range(900)]
    state = spark.createDataFrame([("10.0.0.2", 0, 0, 0, 0, False, False, 0, 4, False)], STATE)
    feed = spark.createDataFrame([("10.0.0.3", 1, 90, 4, False)], FEED)
    hits = spark.createDataFrame(rows, HITS)
    got = {r["seq"] for r in kn.known_refused(hits, state, feed).collect()}
    lost = {r["seq"] for r in kn.unknown_refused(hits, state, feed).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    known, expected = {"10.0.0.2", "10.0.0.3"}, set()
    for ip, _, seq, kind, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "activity":
            known.add(ip)
        if ip in known:
            expected.add(seq)
    assert got == expected
    assert lost == {r[2] for r in rows} - expected
    assert lost


STATES = [  # ip, la, score, whitelisted, blacklisted, has_rule
    ("hot", 1000, 90000, False, False, False),
    ("edge", 1000, 36000, False, False, False),
    ("cold", 1000, 10, False, False, True),
    ("warm", 1000, 500, False, False, True),
    ("white", 1000, 90000, True, False, True),
    ("white2", 1000, 90000, True, False, False),
    ("black", 0, 0, False, True, False),
    ("blackrule", 0, 0, False, True, True),
    ("fed", 0, 0, False, False, True),
    ("both", 0, 0, False, False, False),
]


def tables(spark):
    state = spark.createDataFrame(
        [(ip, la, s, 1, 0, w, b, 0, 4, r) for ip, la, s, w, b, r in STATES], STATE)
    feed = spark.createDataFrame(
        [("fed", 1, 10, 4, False), ("both", 1, 95, 4, False), ("only", 1, 90, 6, False), ("low", 1, 89, 4, False),
         ("white2", 1, 99, 4, False)], FEED)
    return state, feed


def test_firewall_plan(spark):
    state, feed = tables(spark)
    listing = spark.createDataFrame(
        [(4, "-A INPUT -s 9.9.9.9/32 -j DROP"), (4, "-A INPUT -s 8.8.8.8/32 -j DROP"), (4, "-P INPUT ACCEPT")],
        "ip_version int, line string")
    settings = Settings()
    parsed = fw.parse_rules(listing, settings.rule_template)
    dropped = spark.createDataFrame([("8.8.8.8",)], "ip string")
    got = {r["ip"]: (r["action"], r["command"]) for r in fw.firewall_plan(state, feed, parsed, settings, 1200, dropped).collect()}
    assert got == {
        "hot": ("ADD", "iptables -I INPUT 1 -s hot -j DROP"),
        "cold": ("REMOVE", "iptables -D INPUT -s cold -j DROP"),
        "warm": ("KEEP", None),
        "white": ("REMOVE", "iptables -D INPUT -s white -j DROP"),
        "black": ("ADD", "iptables -I INPUT 1 -s black -j DROP"),
        "blackrule": ("KEEP", None),
        "fed": ("KEEP", None),
        "both": ("ADD", "iptables -I INPUT 1 -s both -j DROP"),
        "only": ("ADD", "ip6tables -I INPUT 1 -s only -j DROP"),
        "9.9.9.9": ("UNKNOWN", None),
        "8.8.8.8": ("REMOVE", "iptables -D INPUT -s 8.8.8.8 -j DROP"),
    }
    assert {r["ip"] for r in fw.unknown_rules(parsed, state, feed).collect()} == {"9.9.9.9", "8.8.8.8"}
    plan = fw.firewall_plan(state, feed, parsed, settings, 1200)
    after = {r["ip"]: r["has_rule"] for r in fw.apply_plan(state, plan).collect()}
    assert after["hot"] and after["warm"] and not after["cold"] and not after["white"] and not after["edge"]


def test_template_change_and_flag_sharing(spark):
    listing = spark.createDataFrame([(6, "-A INPUT -s 2001:db8::1/128 -j DROP")], "ip_version int, line string")
    new = Settings(rule_template="-s %i -j LOGDROP", append_rules=True)
    got = [r["command"] for r in fw.migrate_rule_template(listing, Settings(), new).collect()]
    assert got == ["ip6tables -D INPUT -s 2001:db8::1 -j DROP", "ip6tables -A INPUT -s 2001:db8::1 -j LOGDROP"]
    state, feed = tables(spark)
    s, f = fw.sync_rule_flag(state, feed)
    assert f.filter("ip = 'fed'").first()["has_rule"]
    assert not s.filter("ip = 'both'").first()["has_rule"]


def test_feed_sync(spark):
    old = spark.createDataFrame([("1.1.1.1", 1, 90, 4, True), ("2.2.2.2", 2, 91, 4, False)], FEED)
    new = spark.createDataFrame([("2.2.2.2", 5, 99, -1, False), ("2001:db8::1", 3, 95, -1, False)], FEED)
    diff = fd.diff_feed(old, new)
    assert {r["action"]: r["n"] for r in fd.feed_change_counts(diff).collect()} == {"new": 1, "updated": 1, "removed": 1}
    assert sorted(map(tuple, fd.apply_feed_diff(diff).collect())) == [
        ("2.2.2.2", 5, 99, 4, False), ("2001:db8::1", 3, 95, 6, False)]
    assert [r["ip"] for r in fd.removed_from_feed(diff).collect()] == ["1.1.1.1"]
    saved = fd.save_feed_records(old, spark.createDataFrame([("1.1.1.1", 9, 400)], "ip string, total_reports long, confidence int"))
    assert sorted(map(tuple, saved.collect())) == [("1.1.1.1", 9, 100, 4, True), ("2.2.2.2", 2, 91, 4, False)]
    meta = [spark.createDataFrame([(1, g)], FEED_META) for g in (5, 6)]
    assert fd.feed_generation_check(meta[0], meta[1]).first()["result"] == "newer"
    assert fd.feed_generation_check(meta[1], meta[0]).first()["result"] == "older"
    assert meta[0].select(fd.sync_due(100, 101), fd.sync_due(100, 100), fd.sync_due(0, 500)).first()[:] == (True, False, False)


@pytest.mark.parametrize("multiplier", [3600, 0])
def test_statistics(spark, multiplier):
    settings = Settings(multiplier=multiplier)
    state, feed = tables(spark)
    meta = spark.createDataFrame([(7, 8)], FEED_META)
    r = stats.summary(state, feed, meta, settings, 1200).first()
    assert (r["addresses"], r["feed_size"], r["sync_time"], r["gen_time"]) == (10, 5, 7, 8)
    assert (r["total_activity"], r["total_whitelisted"], r["total_blacklisted"]) == (10, 2, 2)
    assert r["total_blocked"] == (3 if multiplier else 5)
    assert [x["ip"] for x in stats.top_active(state, settings, 1200).collect()] == sorted(s[0] for s in STATES)[:5]
    top = {x["ip"]: x["status"] for x in stats.last_active(state, settings, 1200).collect()}
    assert top["hot"] == ("1970-01-02 01:16:40" if multiplier else "blocked")
    assert top["warm"] == ("" if multiplier else "blocked")
    listed = [x["ip"] for x in stats.list_addresses(state, settings, 1200).collect()]
    assert listed[:2] == ["black", "blackrule"] and "white" not in listed
    every = stats.list_addresses(state, settings, 1200, every=True, count=True, time=True)
    assert every.count() == 10 and every.columns == ["ip", "activity_count", "score", "refused_count", "last_activity"]


def test_fold_helper_matches_fixture_scores():
    rows = [("a", 5, 1, "activity", 2), ("a", 5, 2, "activity", 20)]
    assert fold(rows, 3600)[0]["a"] == (5, 79200, 2, 0)
