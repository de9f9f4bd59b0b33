import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import arrow, ngrams, quality_classifier, quality_rules


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    hit = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def corpus(pick, n):
    rows, marks = [], []
    pool = [f"{a}{b}" for a in ("the", "on", "er", "in", "re") for b in ("ha", "st", "nd", "ou", "", "ti")]
    for k in range(n):
        w = [pick.choice(pool) for _ in range(pick.randint(60, 200))]
        bad = k % 4 == 0
        if bad:
            w = [x + "$$$" for x in w] if k % 8 else [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w)))
        marks.append((k, int(not bad), 0))
    return rows, marks


def test_counts_and_base_rules(documents, labels, odd):
    pick = random.Random(1)
    extra = ["\n".join(pick.choice(["a b c", "a  b", "", " ", "x"]) for _ in range(12)) for _ in range(40)]
    rows = odd + [(100 + k, t) for k, t in enumerate(extra)]
    forest = quality_rules.learned(documents(rows), labels([]))
    got = quality_rules.judged(documents(rows), forest).collect()
    want = sorted(((i or 0, *brute_counts(t)) for i, t in rows))
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # nothing learned against a document
    assert quality_rules.judged(documents([]), forest).collect() == []


def test_trees_are_monotone_and_flat_scores_are_those_of_walks():
    pick = np.random.default_rng(0)
    x = pick.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.5 * x[:, 1] + 0.1 * pick.standard_normal(600) < 0.8).astype(float)
    forest = quality_rules.grow(x, y, [-1, 0, 0])
    grid = np.linspace(0, 1, 50)
    for other in pick.random((20, 2)):
        line = forest.score(np.c_[grid, np.tile(other, (50, 1))])
        assert (np.diff(line) <= 1e-12).all()
    for row in x[:50]:
        total = forest.start
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert np.isclose(forest.score(row[None])[0], 1 / (1 + np.exp(-total)))
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_rules_learn_and_keep_columns(documents, labels):
    rows, marks = corpus(random.Random(2), 160)
    forest = quality_rules.learned(documents(rows), labels(marks + marks[:9] + [(None, 1, 0), (3, 0, 0)]))
    kept = quality_rules.passing(documents(rows), forest)
    assert kept.columns == documents([]).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, good, _ in marks if good}


def test_classifier_on_rows_it_never_saw(documents, labels):
    rows, marks = corpus(random.Random(3), 240)
    model = quality_classifier.learned(documents(rows), labels(marks))
    good = {i: g for i, g, _ in marks}
    got = quality_classifier.scored(documents(rows), model).collect()
    assert any(r.held_out for r in got) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == good[r.doc_id] == (r.score >= 0.7) for r in got)
    assert {r.doc_id for r in quality_classifier.passing(documents(rows), model).collect()} == {i for i in good if good[i]}


def test_held_out_labels_teach_nothing(documents, labels):
    rows, marks = corpus(random.Random(4), 120)
    import zlib

    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in marks]
    one, other = (quality_classifier.learned(documents(rows), labels(m)) for m in (marks, wrong))
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


@pytest.mark.parametrize("marks", [[], [(4, 1, 0)], [(None, 0, 0), (4, 0, 0), (4, 1, 0)]])
def test_classifier_odd_rows(documents, labels, odd, marks):
    model = quality_classifier.learned(documents(odd), labels(marks))
    got = quality_classifier.scored(documents(odd), model).collect()
    assert len(got) == len(odd) and all(r.predicted == 1 for r in got)
    assert quality_classifier.scored(documents([]), model).collect() == []


def test_accuracy_on_the_test_table(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.learned(docs, marks)
    got = quality_classifier.scored(docs, model).where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9
    verdicts = quality_rules.judged(docs, quality_rules.learned(docs, marks)).join(marks, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in verdicts]) >= 0.97


def test_a_text_scores_the_same_alone_and_among_others():
    pick = random.Random(3)
    texts = ["", "a", "abc", " ", "The", "Öl", None, ""] + ["".join(pick.choice("ab T.é$ ") for _ in range(pick.randint(0, 60))) for _ in range(60)]
    weights = np.random.default_rng(1).standard_normal(1 << quality_classifier.BITS)
    model = quality_classifier.Model(weights, 0.1, 0.01, 0.0)
    alone = [quality_classifier.score_rows(arrow.texts(pa.array([t], pa.string())), model)[0] for t in texts]
    for _ in range(3):
        order = pick.sample(range(len(texts)), len(texts))
        among = quality_classifier.score_rows(arrow.texts(pa.array([texts[k] for k in order], pa.string())), model)
        assert among.tolist() == [alone[k] for k in order]
    assert len(ngrams.character_grams(arrow.texts(pa.array([""])), quality_classifier.BITS)[1]) == 2  # white space, in both tables


def test_solver_against_plain_descent(monkeypatch):
    """The same dual, dense and with loops in a fixed order, run until nothing moves."""
    pick = np.random.default_rng(4)
    size, n = 30, 60
    x = pick.random((n, size)) < 0.2
    x[:5] = False
    y = (x[:, :6].sum(1) + pick.normal(0, 0.7, n) > 1).astype(int)
    ends, slots = np.r_[0, np.cumsum(x.sum(1))], np.nonzero(x)[1]
    scale = quality_classifier.log_ratios(ends, slots, y, size)
    for k in range(size):  # the ratios by their definition
        good, bad = ([1 + sum(bool(x[i, j]) for i in range(n) if y[i] == label) for j in range(size)] for label in (1, 0))
        assert abs(scale[k] - np.log(good[k] / sum(good) / (bad[k] / sum(bad)))) < 1e-12
    sign = np.where(y == 1, 1.0, -1.0)
    wide = np.c_[x * scale, np.ones(n)] * sign[:, None]
    kernel, alpha = wide @ wide.T, np.zeros(n)
    for _ in range(4_000):
        for i in range(n):
            alpha[i] = min(max(alpha[i] - (kernel[i] @ alpha - 1) / kernel[i, i], 0.0), quality_classifier.COST)
    best = alpha @ wide

    def objective(w):
        return w @ w / 2 + quality_classifier.COST * np.maximum(1 - wide @ w, 0).sum()

    def solved():
        weights, bias = quality_classifier.descend(ends, slots, y, scale, np.arange(n))
        return np.r_[np.divide(weights, scale, out=np.zeros(size), where=scale != 0), bias]

    assert objective(solved()) < 1.05 * objective(best)
    monkeypatch.setattr(quality_classifier, "EPOCHS", 4_000)
    gap = 1e-3 * n * quality_classifier.COST  # it stops once no row's margin moves by more than 1e-3
    assert objective(best) - 1e-9 <= objective(solved()) < objective(best) + gap
    assert np.abs(solved() - best).max() < 0.01
