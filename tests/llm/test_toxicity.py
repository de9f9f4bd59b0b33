import math
import random

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import toxicity


def corpus(pick, n):
    pool = [f"{a}{b}{c}" for a in ("tha", "on", "er", "in", "re") for b in ("ha", "st", "nd") for c in ("", "ou", "ti", "le")]
    rude = ["fleep", "grobnik", "zarquon"]
    rows, marks = [], []
    for k in range(n):
        w = [pick.choice(pool) for _ in range(pick.randint(30, 120))]
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            w[pick.randrange(len(w))] = pick.choice(rude)
        rows.append((k, " ".join(w)))
        if k % 2 == 0 or not bad:  # every second toxic text is unlabelled
            marks.append((k, 1, int(bad)))
    return rows, marks


def test_finds_what_is_not_labelled(documents, labels):
    rows, marks = corpus(random.Random(1), 500)
    model = toxicity.learned(documents(rows), labels(marks))
    got = toxicity.scored(documents(rows), model).collect()
    assert any(r.held_out for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in got]) > 0.98


def plain_risk(margins, positive, prior):
    """(positives as positive, the unlabelled's part) by the definition, row after row."""
    def chance(m):
        return 1 / (1 + math.exp(-m))

    up = [m for m, p in zip(margins, positive) if p]
    rest = [m for m, p in zip(margins, positive) if not p]
    first = prior * sum(1 - chance(m) for m in up) / len(up)
    return first, sum(map(chance, rest)) / len(rest) - prior * sum(map(chance, up)) / len(up)


@pytest.mark.parametrize("seed, prior, low", [(1, 0.1, False), (2, 0.3, False), (3, 0.9, True), (4, 0.6, True)])
def test_risk_and_slope_against_the_definition(seed, prior, low):
    pick = np.random.default_rng(seed)
    positive = np.arange(40) < 12
    margin = pick.normal(0, 1, 40) + np.where(positive, 2.0, -4.0 if low else 0.0)
    value, slope = toxicity.risk(margin, positive, prior)
    first, second = plain_risk(margin, positive, prior)
    assert (second < 0) == low and abs(value - first - max(second, 0)) < 1e-12 and value >= 0
    for k in range(40):
        parts = []
        for step in (1e-5, -1e-5):
            moved = margin.copy()
            moved[k] += step
            parts.append(plain_risk(moved, positive, prior))
        (a, b), (c, d) = parts
        expected = -(b - d) / 2e-5 if low else (a + b - c - d) / 2e-5
        assert abs(slope[k] - expected) < 1e-7


def test_separable_rows_do_not_sink_for_ever():
    """Without the lower bound, the unlabelled's part would go on falling to -prior."""
    ends = np.arange(0, 201)
    slots = np.r_[np.zeros(50, int), np.zeros(10, int), np.ones(140, int)]
    y = np.r_[np.ones(50, int), np.zeros(150, int)]
    model = toxicity.fit(ends, slots, y, 0.5, 4)
    _, part = plain_risk((model.weights[slots] + model.bias).tolist(), (y == 1).tolist(), 0.5)
    assert part > -0.25


def test_words_are_counted_over_all_rows(documents):
    rows, _ = corpus(random.Random(3), 90)
    texts = [t for _, t in rows] + [None, "", rows[0][1]]
    got = toxicity.slot_counts(documents(list(enumerate(texts))).repartition(5), 12)
    expected = np.zeros(1 << 12)
    for text in texts:
        ends, slots = toxicity.ngrams.word_grams(toxicity.arrow.texts(pa.array([text], pa.string())), 12)
        expected[sorted(set(slots.tolist()))] += 1
    assert got.rows == len(texts) and (got.slots == expected).all()
    none = toxicity.slot_counts(documents([]), 12)
    assert none.rows == 0 and not none.slots.any()


def test_odd_rows(documents, labels, odd):
    for marks in ([], [(4, 1, 1)], [(None, 1, 1), (6, 1, None)]):
        model = toxicity.learned(documents(odd), labels(marks))
        got = toxicity.scored(documents(odd), model).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert toxicity.scored(documents([]), model).collect() == []


def test_accuracy_on_the_test_table(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learned(docs, marks)
    got = toxicity.scored(docs, model).where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
