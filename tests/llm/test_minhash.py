import random
import re

import numpy as np
import pytest

from logwarden.llm import minhash


def brute(rows, size, threshold=80):
    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(k)
    least = {k: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for k in g}
    return sorted(((rows[k][0] or -1, len(sets[k]), least[k] or 0) for k in range(len(rows))))


def found(df):
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id or 0) for r in df.collect())


def variants(pick, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(pick.randint(0, edits)):
            w[pick.randrange(len(w))] = f"x{pick.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_components_against_brute_force(documents, monkeypatch, block):
    """With small blocks every large group is compared block against block; then the list
    of candidates is also joined by a shuffle."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash, "SMALL_LIST", 0 if block == 4 else 1000)
    pick = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{pick.randrange(3000)}" for _ in range(pick.randint(30, 120))]
        texts += variants(pick, base, 14, 8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{pick.randrange(10**6)}" for _ in range(pick.randint(5, 60))) for _ in range(20)]
    texts += [texts[0]] * 5 + ["a b", "A b", "a  b\n", None, "", " "]
    pick.shuffle(texts)
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    for size in (4, 5):
        assert found(minhash.near_duplicates(documents(rows), size=size)) == brute(rows, size)


def test_odd_rows(documents, odd):
    rows = odd + [(None, "no id HERE"), (9, "No id here"), (None, "alone without id")]
    assert found(minhash.near_duplicates(documents(rows))) == brute(rows, 5)
    assert minhash.near_duplicates(documents([])).collect() == []
    kept = minhash.representatives(documents(rows))
    assert kept.columns == documents([]).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_one_row_of_each_component_stays_whatever_its_id(documents):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    near = " ".join([*b[:-1], "other"])
    rows = [(1, " ".join(b)), (5, " ".join(a)), (5, near), (None, "no id and alone here"), (None, "no id and alone here"), (None, near),
            (None, ""), (None, None), (7, ""), (7, "")]
    want = [(1, " ".join(b)), (5, " ".join(a)), (7, ""), (None, "no id and alone here"), (None, ""), (None, None)]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text) for r in minhash.representatives(documents(order)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_signatures_estimate_similarity():
    """Circulant coordinates agree as often as the sets are similar."""
    pick = np.random.default_rng(3)
    shared = pick.integers(0, 2**63, 400).astype(np.uint64)
    for own in (25, 100, 300):
        a, b = (np.unique(np.r_[shared, pick.integers(0, 2**63, own).astype(np.uint64)]) for _ in range(2))
        x, y = minhash.signatures([a, b], 1024)
        assert abs((x == y).mean() - 400 / (400 + 2 * own)) < 0.06


def test_linked_pairs_against_sets():
    pick = np.random.default_rng(5)
    sets = [np.unique(pick.integers(0, 60, pick.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s, np.uint64(1000 + k)]) for k, s in enumerate(sets[:20])]
    both = np.arange(len(sets))
    near = minhash.linked(sets, both, both, 80)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            if i != j:
                assert near[i, j] == (100 * common >= 80 * (len(a) + len(b) - common) and common > 0)
