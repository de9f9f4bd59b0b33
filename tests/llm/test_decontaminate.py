import random
import re
import time

import pyarrow as pa
import pytest

from logwarden.llm import decontaminate


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        v = words(other)
        m = min(len(v), window)
        for k in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j:j + m] == v[k:k + m]:
                    hit |= set(range(j, j + m))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, documents, monkeypatch):
    pick = random.Random(6)
    pool = "a b c dé 日本 x9 Q".split()

    def text(n):
        return " .,\n"[pick.randrange(4)].join(pick.choice(pool) for _ in range(pick.randint(0, n)))

    items = [(k, text(9)) for k in range(10)] + [(3, "a b"), (None, "c Q c"), (99, None), (98, "...")]
    texts = [text(60) for _ in range(60)] + [None, "", "Q"]
    for limit in (1 << 20, 40):  # one block of the benchmark, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        found = decontaminate.benchmark_hits(documents(list(enumerate(texts))), benchmark(spark, items), window=3)
        for row in found.collect():
            assert (row.n_words, row.n_hit, row.items) == brute(texts[row.doc_id], items, 3)
            inside = {k for a, b in zip(row.spans[::2], row.spans[1::2]) for k in range(a, b)}
            assert len(inside) == row.n_hit
        clean = decontaminate.uncontaminated(documents(list(enumerate(texts))), benchmark(spark, items), window=3)
        assert {r.doc_id for r in clean.collect()} == {k for k, t in enumerate(texts) if not brute(t, items, 3)[1]}
        assert clean.columns == documents([]).columns


def test_odd_rows_and_empty_tables(spark, documents, odd):
    items = [(1, "one"), (2, "word " * 12), (3, "no id HERE"), (None, None)]
    got = decontaminate.report(documents(odd), benchmark(spark, items)).collect()
    assert len(got) == len(odd)
    hits = {r.doc_id: r.n_hit for r in got}
    assert hits[1] == hits[2] == hits[3] == 0 and hits[4] == 1 and hits[6] == 30_000 and hits[None] == 3
    assert all(r.n_hit == 0 for r in decontaminate.report(documents(odd), benchmark(spark, [])).collect())
    assert decontaminate.report(documents([]), benchmark(spark, items)).collect() == []


def test_windows_that_items_share_are_searched_for_once():
    """Many items with one sentence, and many windows with one ending."""
    shared = " ".join(f"w{k}" for k in range(30))

    def spent(n):
        items = [(str(k), f"{shared} own{k} a b c d e f g h of the") for k in range(n)]
        tables = decontaminate.tables_of(items, 10)
        column = decontaminate.arrow.texts(pa.array([f"{shared} x " * 3 + "u v w x y z a of the " * 50] * 50))
        best = []
        for _ in range(3):
            began = time.perf_counter()
            firsts = [decontaminate.occurrences(decontaminate.words_of(column, decontaminate.FOLD), g, tables.text)[0] for g in tables.groups]
            best.append(time.perf_counter() - began)
            assert sum(map(len, firsts)) == 50 * 3 * 21
        empty = pa.array([[]] * 50, pa.list_(pa.string()))
        found = decontaminate.search(column, pa.array([[]] * 50, pa.list_(pa.int32())), empty, tables)
        assert found[3].to_pylist() == [sorted(k for k, _ in items)] * 50
        return min(best)

    spent(10)
    assert spent(3_000) < 0.05 + 3 * spent(30)


def test_equal_hashes_of_different_windows(monkeypatch, spark, documents):
    monkeypatch.setattr(decontaminate, "window_hash", lambda words, firsts, length: firsts.astype("uint64") * 0)
    items = [(k, f"a{k} b c d") for k in range(5)] + [(9, "a1 b c d")]
    tables = decontaminate.tables_of([(str(k), t) for k, t in items], 3)
    column = decontaminate.arrow.texts(pa.array(["x a1 b c d", "a3 b c", "a7 b c d"]))
    empty = pa.array([[]] * 3, pa.list_(pa.string()))
    found = decontaminate.search(column, pa.array([[]] * 3, pa.list_(pa.int32())), empty, tables)
    expected = [brute(t, items, 3) for t in column.to_pylist()]
    assert [(a, b, c) for a, b, c in zip(found[0].to_pylist(), found[1].to_pylist(), found[3].to_pylist())] == expected


def test_kept_columns_do_not_hide_results(spark, documents):
    with pytest.raises(ValueError):
        decontaminate.benchmark_hits(documents([]).selectExpr("doc_id", "text", "1 AS Spans"), benchmark(spark, []), keep=("doc_id", "Spans"))
