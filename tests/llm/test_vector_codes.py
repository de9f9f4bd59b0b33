import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import catalog, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cells int, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def brute_force(rows):
    """Plain loops over whole numbers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // 8
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(8)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def nearest(p, x):
        return min((apart(x, entry), k) for k, entry in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            members = {}
            for _, v, _ in kept:
                x = v[p * width:(p + 1) * width]
                members.setdefault(nearest(p, x)[1], []).append(x)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    digest = vector_codes.digest(np.array(books))
    out, totals = [], {}
    for i, v, label in kept:
        found = [nearest(p, v[p * width:(p + 1) * width]) for p in range(8)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return [(i, code, error, totals[label], digest) for i, code, error, label in out]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_equal_to_plain_loops(spark):
    """Hot labels and no label, null and non-finite components, ties on a coarse lattice,
    repeated rows and ids, a null id."""
    pick = random.Random(1)
    rows = [(k, [pick.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(16)], pick.choice([1, 1, 1, 2, None])) for k in range(150)]
    rows += [(k + 200, [pick.uniform(-3, 3) for _ in range(16)], 1) for k in range(150)]
    rows += [rows[0], rows[200], (5, rows[7][1], 2), (None, rows[3][1], 3)]
    rows += [(900, None, 1), (901, [0.1] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [0.1] * 15 + [float("inf")], 1)]
    got = vector_codes.compressed(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_force(rows), key=key)


def test_few_or_no_rows(spark):
    rows = [(k, [float(k)] * 8, None) for k in range(3)]
    assert sorted(map(tuple, vector_codes.compressed(table(spark, rows)).collect())) == brute_force(rows)
    assert vector_codes.compressed(table(spark, rows).limit(0)).collect() == []
    assert vector_codes.compressed(table(spark, [(1, None, 1)])).collect() == []


@pytest.mark.parametrize("rows", [[(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [40_000.0] * 8, 1)]])
def test_refused(spark, rows):
    with pytest.raises(Exception, match="equally long|beyond"):
        vector_codes.compressed(table(spark, rows)).collect()


@pytest.mark.parametrize("bits", [0, 3, 7, 12])
def test_cells_leave_out_no_nearest_entry(bits, monkeypatch):
    """Whatever the cells' width, also when all of them share one hash."""
    numbers = np.random.default_rng(2)
    entries, parts = numbers.integers(-1000, 1000, (16, 3)), numbers.integers(-1500, 1500, (2000, 3))
    memo = vector_codes.Memo(entries)
    memo.bits = bits
    apart = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for _ in range(2):  # the second time from the memo
        index, distance = memo.nearest(parts)
        assert np.array_equal(index, apart.argmin(axis=1)) and np.array_equal(distance, apart.min(axis=1))
        monkeypatch.setattr(vector_codes, "_MIX", np.uint64(0))


def test_bounded_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(vector_codes, "CACHED_CELLS", 10)
    test_cells_leave_out_no_nearest_entry(3, monkeypatch)


def test_decoded_vectors_are_near(spark, sf_dir):
    embeddings = catalog.table(spark, sf_dir, "embeddings")
    numbers = vector_codes.whole_numbers(embeddings)
    books = vector_codes.trained(numbers)
    codes = vector_codes.decoded(vector_codes.coded(numbers, books), books)
    joined = codes.join(embeddings.select("vec_id", "embedding"), "vec_id")
    squares = F.aggregate(F.zip_with("embedding", "approximate", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    for row in joined.select("error", squares.alias("squares")).collect():
        assert row.squares == pytest.approx(row.error / 4096**2, rel=0.02, abs=1e-4)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = catalog.op13_vector_codes(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(vector_codes.ORACLE).fetchall())
