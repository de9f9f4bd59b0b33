import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logwarden import Settings
from logwarden.operators import report as rp
from logwarden.schemas import STATE


def greedy(times, gap, last):
    out = []
    for t in sorted(set(times)):
        if t - last >= gap:
            out.append(t)
            last = t
    return out


def test_throttle_is_the_greedy_choice(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    base = 1_700_000_000
    rows, seq = [], 0
    for i in range(25):
        for _ in range(rng.choice([1, 5, 300])):
            seq += 1
            rows.append((f"ip{i}", base + rng.randint(0, rng.choice([50, 5000, 90000])), seq))
    rng.shuffle(rows)
    stored = {f"ip{i}": base + rng.randint(-2000, 2000) for i in range(0, 25, 3)}
    state = spark.createDataFrame([(ip, 0, 0, 0, 0, False, False, t, 4, False) for ip, t in stored.items()], STATE)
    allowed = spark.createDataFrame([("quiet", 0, 0, 0, 0, True, False, 0, 4, False)], STATE)
    candidates = spark.createDataFrame(rows + [("quiet", base, 0)], "ip string, ts long, seq long")
    got = rp.throttle_reports(candidates, state.unionByName(allowed)).collect()
    assert "quiet" not in {r["ip"] for r in got}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(25):
        ip = f"ip{i}"
        mine = [(t, s) for p, t, s in rows if p == ip]
        times = greedy([t for t, _ in mine], 900, stored.get(ip, 0))
        expected = [(t, min(s for x, s in mine if x == t)) for t in times]
        assert sorted((r["ts"], r["seq"]) for r in got if r["ip"] == ip) == expected


def test_blocks_choose_as_one_pass(spark):
    """Blocks of a gap's length up, cut anywhere, batches that end within a block, a stored
    report within or behind the log, a line that is a candidate twice."""
    rng = random.Random(11)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(f"ip{i}", rng.randint(0, 4000), rng.randint(0, 10**6)) for i in range(12) for _ in range(rng.choice([1, 20, 200]))]
    rows += [("hot", t, 5) for t in range(0, 3000)] + [("hot", 7, 5), ("hot", 7, 4)]
    stored = {"ip1": 1500, "ip2": 9999, "hot": 33}
    state = spark.createDataFrame([(ip, 0, 0, 0, 0, False, False, t, 4, False) for ip, t in stored.items()], STATE)
    candidates = spark.createDataFrame(rows, "ip string, ts long, seq long")
    for block in (100, 101, 1000, 86_400):
        got = sorted(tuple(r) for r in rp.throttle_reports(candidates, state, 100, block).collect())
        want = []
        for ip in sorted({r[0] for r in rows}):
            times = greedy([t for i, t, _ in rows if i == ip], 100, stored.get(ip, 0))
            want += [(ip, t, min(s for i, x, s in rows if (i, x) == (ip, t))) for t in times]
        assert got == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables_of_a_block_are_short():
    """A second-by-second block of a day: as many entries as the gap has seconds, and one."""
    day = pa.RecordBatch.from_pydict({"ip": ["a"] * 86_400, "block": [3] * 86_400, "ts": list(range(3 * 86_400, 4 * 86_400))})
    table = pa.Table.from_batches(rp.block_functions(iter([day.slice(0, 500), day.slice(500)]), 900, 86_400))
    assert table.num_rows == 1 and len(table.column("since")[0]) <= 901


def test_pick_spaced_carries_over_batches():
    whole = pd.DataFrame({"ip": ["a"] * 50 + ["b"] * 50, "ts": list(range(0, 5000, 100)) * 2, "last_reported": -900, "block": 0})
    once = pd.concat(rp.pick_spaced(iter([whole]), 900))
    cut = pd.concat(rp.pick_spaced(iter([whole[:3], whole[3:3], whole[3:49], whole[49:]]), 900))
    assert once.values.tolist() == cut.values.tolist()
    assert once[once.ip == "a"].ts.tolist() == greedy(range(0, 5000, 100), 900, -900)


def test_rate_limit(spark):
    rng = random.Random(4)
    pauses = [(rng.randint(0, 40000), rng.choice([0, 10, 3000, 9000])) for _ in range(8)]
    times = [rng.randint(0, 60000) for _ in range(500)]
    reports = spark.createDataFrame([(t,) for t in times], "ts long")
    got = rp.suppress_rate_limited(reports, spark.createDataFrame(pauses, "ts long, retry_after long"))
    kept = [t for t in times if not any(p <= t < p + n for p, n in pauses)]
    assert sorted(r["ts"] for r in got.collect()) == sorted(kept)


def test_mask_list_and_categories(spark):
    hosts = spark.createDataFrame([("web1.example.org", "10.0.0.1"), ("db", "fe80::1%eth0"), (None, "10.0.0.1")],
                                  "host string, addr string")
    assert {r["text"] for r in rp.mask_list(hosts).collect()} == {"web1.example.org", "web1", "10.0.0.1", "db", "fe80::1"}
    cats = spark.createDataFrame([([14, 22, 99],)], "categories array<int>")
    assert [r["category_name"] for r in rp.category_names(cats).orderBy("category").collect()] == ["PortScan", "SSH", None]


def test_not_whitelisted(spark):
    state = spark.createDataFrame([("a", 0, 0, 0, 0, True, False, 0, 4, False)], STATE)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "ip string, ts long")
    assert [r["ip"] for r in rp.not_whitelisted(rows, state).collect()] == ["b"]
    assert rp.mark_reported(state, rows).filter(F.col("last_reported") == 1).count() == 1


def test_masks_from_a_table_whole_names_first(spark):
    hosts = spark.createDataFrame([("web1.example.org", "10.0.0.1"), (None, "fe80::1%eth0"), ("db", None)], "host string, addr string")
    rows = [("1.1.1.1", 0, [1], "web1.example.org web1 db fe80::1 10.0.0.12", None, None)]
    emitted = spark.createDataFrame(rows, "ip string, ts long, categories array<int>, comment string, port int, line string")
    got = rp.render_reports(emitted, Settings(), rp.mask_list(hosts)).first()["comment"]
    assert got == f"{'*' * 16} {'*' * 4} {'*' * 2} {'*' * 7} {'*' * 8}2"
    none = rp.render_reports(emitted, Settings(), rp.mask_list(hosts.limit(0))).first()["comment"]
    assert none == rows[0][3]


def test_too_many_masks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rp, "MASK_LIMIT", 2)
    hosts = spark.createDataFrame([("a", "b"), ("c", None)], "host string, addr string")
    with pytest.raises(Exception, match="more than 2 texts"):
        spark.range(1).select(rp.mask_array(rp.mask_list(hosts))).collect()


def test_started_blocks_choose_across_batches():
    """A block's beginning may lie in a batch before its seconds; ``seq`` of any type goes along."""
    rows = [("a", 0, None, None, -900), *(("a", 0, t, {"n": t}, None) for t in range(0, 5000, 100)), ("b", 0, None, None, 1000),
            *(("b", 0, t, {"n": t}, None) for t in range(0, 5000, 100))]
    fields = [("ip", pa.string()), ("block", pa.int64()), ("ts", pa.int64()), ("seq", pa.struct([("n", pa.int64())])), ("last_reported", pa.int64())]
    batch = pa.RecordBatch.from_pylist([dict(zip((f for f, _ in fields), r)) for r in rows], schema=pa.schema(fields))
    want = [(ip, t) for ip, last in (("a", -900), ("b", 1000)) for t in greedy(range(0, 5000, 100), 900, last)]
    for cuts in ([0, 102], [0, 1, 51, 52, 102], [0, 0, 30, 60, 102]):
        parts = [batch.slice(p, q - p) for p, q in zip(cuts, cuts[1:])]
        got = [r for out in rp.pick_started(iter(parts), 900) for r in out.to_pylist()]
        assert [(r["ip"], r["ts"]) for r in got] == want and all(r["seq"]["n"] == r["ts"] for r in got)


def test_candidates_move_twice(spark):
    """Whole candidates are moved once, to be looked up, and seconds for each table that is made of them."""
    state = spark.createDataFrame([], STATE)
    candidates = spark.createDataFrame([("a", 5000 + t, t, "line") for t in range(50)], "ip string, ts long, seq long, line string")
    out = rp.throttle_reports(candidates, state)
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 5
