import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from logwarden.llm import align, backtrack, catalog

from tests.llm.conftest import ODD


def brute_force(texts):
    """Row by row with the libraries, groups by a walk over both sides."""
    words = Tokenizer.from_file(align.FIRST)
    words.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=align.SECOND)
    letters = backtrack.byte_letters()
    token_of = {number: token for token, number in words.get_vocab().items()}
    piece = lambda k: bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
    rows, shared = [], collections.Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a, b = words.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        a_bytes, b_bytes = [bytes(letters[c] for c in token_of[k]) for k in a], [piece(k) for k in b]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            rows.append(None)
            continue
        groups, left, right, i, j = [], [], [], 0, 0
        x = y = 0
        while i < len(a) or j < len(b):
            if x <= y:
                left.append(a[i])
                x += len(a_bytes[i])
                i += 1
            else:
                right.append(b[j])
                y += len(b_bytes[j])
                j += 1
            if x == y:
                groups.append((left, right))
                left, right = [], []
        found = collections.Counter((p, q) for left, right in groups for p in left for q in right)
        shared.update(found.keys())
        rows.append((len(a), len(b), groups, found))
    best = collections.Counter()
    for (p, _), n in shared.items():
        best[p] = max(best[p], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, found = row
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            n_a, n_b, len(groups), sum(found.values()), sum(m for pair, m in found.items() if shared[pair] == best[pair[0]]),
            sum(m * shared[pair] for pair, m in found.items()), hashlib.sha256(shown.encode()).hexdigest(),
        ))
    return out


def hard_texts():
    pick = random.Random(5)
    letters = "'''sstmdrevl   \n\t aZ19!?.é日ß　İΣσ▁"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "a<|endoftext|>b <s> </s> <unk>x <0x41>", " ", "\x00", "a" * 30_000, "日本語" * 3000]
    return texts + ["=-" * 9000, " " * 3000, "the cat sat " * 9000, "the cat sat " * 9000]


@pytest.mark.parametrize("settings_of", [{}, {"stretch": 1000, "frequent": 50}, {"stretch": 300, "frequent": 0}])
def test_equal_to_brute_force(documents, settings_of):
    texts = hard_texts()
    got = align.alignment(documents(list(enumerate(texts))), **settings_of).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == brute_force(texts)


def test_odd_rows(documents):
    rows = [*ODD, *ODD]
    got = align.alignment(documents(rows).withColumn("pair", F.lit(1)), stretch=4096).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, *found) for (i, _), found in zip(rows, brute_force([t for _, t in rows]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert align.alignment(documents([]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        align.aligned(documents(ODD).withColumn("pairs", F.lit(1)), ("doc_id", "pairs"))


_ENDS = st.lists(st.integers(1, 400), unique=True, max_size=60).map(sorted)


@settings(max_examples=200, deadline=None)
@given(_ENDS, _ENDS, st.lists(st.integers(0, 400), max_size=6).map(sorted), st.integers(0, 6))
def test_fragments_compose_in_any_grouping(a_ends, b_ends, bounds, middle):
    """Of any stretches, put together in any grouping, as the whole in one go."""
    a_ends, b_ends = np.array(a_ends, np.int64), np.array(b_ends, np.int64)
    a, b = np.arange(len(a_ends)), np.arange(len(b_ends)) + 1000
    cut = [0, *bounds, 401]
    parts = []
    for low, high in zip(cut, cut[1:]):
        x, y = (a_ends >= low) & (a_ends < high), (b_ends >= low) & (b_ends < high)
        parts.append(align.fragment(a[x], a_ends[x], b[y], b_ends[y]))
    middle = min(middle, len(parts))
    halves = [align.compose(p) for p in (parts[:middle], parts[middle:]) if p]
    whole = align.fragment(a, a_ends, b, b_ends)
    for found in (align.compose(parts), align.compose(halves)):
        assert all(np.array_equal(p, q) for p, q in zip(found, whole))
        assert all(np.array_equal(p, q) for p, q in zip(found.prefix + found.suffix, whole.prefix + whole.suffix))


def test_large_groups_are_added_up_first():
    """1,000 equal tokens against 1,500 equal ones are one pair of 1.5 million links."""
    rows, keys, times = align.links(
        np.full(1000, 5), np.full(1500, 7), np.zeros(1000, np.int64), np.zeros(1500, np.int64), np.array([0])
    )
    assert (rows.tolist(), keys.tolist(), times.tolist()) == ([0], [5 << align.SHIFT | 7], [1_500_000])


def test_query(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(catalog.op12_token_alignment(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in got] == brute_force([d.text for d in docs])


def test_links_are_sorted_as_one_number(monkeypatch):
    """Links that fit one number are not sorted by row and pair apart, and are the same."""
    rng = np.random.default_rng(3)
    for top, rows in ((50_000, 300), (5, 3), (1 << 30, 7)):
        a_group, b_group = (np.repeat(np.arange(400), rng.integers(1, 5, 400)) for _ in range(2))
        a, b = (rng.integers(0, top, len(g)).astype(np.int32) for g in (a_group, b_group))
        owner = np.sort(rng.integers(0, rows, 400))
        with monkeypatch.context() as patch:
            patch.setattr(align, "LARGE", 2)  # groups are added up first, and all links sorted as rows
            plain = align.links(a, b, a_group, b_group, owner)
        with monkeypatch.context() as patch:
            patch.setattr(np, "lexsort", lambda _: pytest.fail("sorted twice"))
            got = align.links(a, b, a_group, b_group, owner) if top < 1 << 20 else plain
        assert all(np.array_equal(x, y) for x, y in zip(got, plain))
    nothing = np.zeros(0, np.int32)
    assert [len(x) for x in align.links(nothing, nothing, nothing, nothing, nothing.astype(np.int64))] == [0, 0, 0]
