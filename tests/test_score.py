import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import score as sc
from logwarden.operators import state as st
from logwarden.schemas import STATE

TOP = 4294967295
HITS = "ip string, ts long, seq long, kind string, score long"


def make_hits(seed, n, ips=4, span=400000, big=False):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        ip = f"10.0.0.{min(rng.randint(0, ips - 1), rng.randint(0, ips - 1))}"
        score = rng.choice([0, 1, 2, 5, 20, TOP, 600000]) if big else rng.choice([0, 1, 2, 5, 20])
        rows.append((ip, rng.choice([rng.randint(0, span), 1000 * rng.randint(0, span // 1000)]), seq,
                     rng.choice(["activity", "refused"]), score))
    return rows


def fold(rows, multiplier, seed=None):
    """One address after another, one hit after another."""
    state, trace = dict(seed or {}), {}
    for ip, ts, seq, kind, score in sorted(rows, key=lambda r: (r[1], r[2])):
        add = min(score * (multiplier or 1), TOP)
        if ip in state:
            la, s, a, r = state[ip]
            ts = max(ts, la)
            if multiplier:
                s = max(0, s - (ts - la))
            s = min(TOP, s + add)
        else:
            s, a, r = add, 0, 0
        state[ip] = (ts, s, min(TOP, a + (kind == "activity")), min(TOP, r + (kind == "refused")))
        trace[seq] = s
    return state, trace


@pytest.mark.parametrize("multiplier", [3600, 0, 1])
@pytest.mark.parametrize("big", [False, True])
def test_running_score_is_the_sequential_fold(spark, monkeypatch, multiplier, big):
    monkeypatch.setattr(sc, "SEQ_BLOCK_BITS", 3)
    monkeypatch.setattr(sc, "CHUNK_SECONDS", 50000)
    rows = make_hits(multiplier + big, 600, big=big)
    hits = spark.createDataFrame(rows, HITS)
    got = {r["seq"]: r["running_score"] for r in sc.decayed_score(hits, multiplier).collect()}
    state, trace = fold(rows, multiplier)
    assert got == trace
    final = {r["ip"]: (r["last_activity"], r["score"], r["activity_count"], r["refused_count"])
             for r in st.state_from_hits(hits, multiplier).collect()}
    assert final == state


@pytest.mark.parametrize("multiplier", [3600, 0])
def test_update_state_continues_from_stored_rows(spark, monkeypatch, multiplier):
    monkeypatch.setattr(sc, "CHUNK_SECONDS", 50000)
    rows = make_hits(5, 400, ips=6)
    seed = {"10.0.0.0": (100000, 50000, 7, TOP), "10.0.0.1": (500000, TOP, 1, 1), "10.0.0.9": (5, 6, 7, 8)}
    state = spark.createDataFrame(
        [(ip, *v, False, True, 77, 4, True) for ip, v in seed.items()], STATE)
    hits = spark.createDataFrame(rows, HITS)
    got = {r["ip"]: r for r in st.update_state(state, hits, multiplier).collect()}
    expected, _ = fold(rows, multiplier, seed)
    assert {ip: (r["last_activity"], r["score"], r["activity_count"], r["refused_count"]) for ip, r in got.items()} == expected
    assert got["10.0.0.0"]["blacklisted"] and got["10.0.0.0"]["last_reported"] == 77 and got["10.0.0.0"]["has_rule"]
    assert not got["10.0.0.2"]["blacklisted"] and got["10.0.0.2"]["ip_version"] == 4


def test_activity_by_address(spark):
    rows = make_hits(3, 200)
    got = {r["ip"]: tuple(r)[1:] for r in sc.activity_by_address(spark.createDataFrame(rows, HITS)).collect()}
    expected = {}
    for ip, ts, _, kind, _ in rows:
        a, r, la = expected.get(ip, (0, 0, 0))
        expected[ip] = (a + (kind == "activity"), r + (kind == "refused"), max(la, ts))
    assert got == expected


def test_saturation_of_counts(spark):
    state = spark.createDataFrame([("1.1.1.1", 10, TOP, TOP, TOP, False, False, 0, 4, False)], STATE)
    hits = spark.createDataFrame([("1.1.1.1", 10, 1, "activity", 10), ("1.1.1.1", 10, 2, "refused", 100)], HITS)
    r = st.update_state(state, hits, 3600).first()
    assert (r["score"], r["activity_count"], r["refused_count"]) == (TOP, TOP, TOP)


@pytest.mark.parametrize("flag,other", [("blacklisted", "whitelisted"), ("whitelisted", "blacklisted")])
def test_toggles_follow_the_commands_one_by_one(spark, flag, other):
    rng = random.Random(11)
    state_rows, commands, expected = [], [], {}
    for i in range(60):
        ip = f"10.1.0.{i}"
        known = i % 4 > 0
        on, on_other = i % 4 == 1, i % 4 == 2
        if known:
            w, b = (on_other, on) if flag == "blacklisted" else (on, on_other)
            state_rows.append((ip, 5, 6, 7, 8, w, b, 9, 4, False))
        mine = [(ip, rng.random() < 0.4, 100 * i + k) for k in range(rng.randint(0, 5))]
        commands += mine
        for _, confirmed, _ in mine:
            if on_other:
                if confirmed:
                    on, on_other = True, False
            else:
                on = not on
        if known or mine:
            expected[ip] = (on, on_other, 5 if known else 1234)
    state = spark.createDataFrame(state_rows, STATE)
    cmds = spark.createDataFrame(commands, "ip string, confirmed boolean, seq long").orderBy(F.rand(1))
    toggle = st.toggle_blacklist if flag == "blacklisted" else st.toggle_whitelist
    got = {r["ip"]: (r[flag], r[other], r["last_activity"]) for r in toggle(state, cmds, 1234).collect()}
    assert got == expected


def test_remove_addresses(spark):
    state = spark.createDataFrame([(ip, 1, 1, 1, 1, False, False, 0, 4, False) for ip in ("a", "b")], STATE)
    ips = spark.createDataFrame([("b",), ("c",)], "ip string")
    assert [r["ip"] for r in st.remove_addresses(state, ips).collect()] == ["a"]
    assert [r["ip"] for r in st.unknown_removals(state, ips).collect()] == ["c"]
