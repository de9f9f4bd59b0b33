import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm import arrow, backtrack, catalog, segment

from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(backtrack.VOCABULARY)


@pytest.fixture(scope="module")
def packed():
    return segment.packed_symbols("tokenizers")


def encoded(texts, packed, special=True):
    ids, rows = backtrack.encode_rows(arrow.texts(pa.array(texts, pa.string())), backtrack.VOCABULARY, packed, special)
    return [ids[a:b].tolist() for a, b in zip(rows, rows[1:])]


def hard_texts():
    pick = random.Random(7)
    letters = "'''sstmdrevl   \n\t aZ19!?.é日ß　́İΣσ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(chr(pick.choice([pick.randrange(32, 0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(300)]
    texts += ["a" * 20_000, " " * 5000, "ab" * 5000, "=-" * 9000, "abcabd" * 2000, "\x00"]
    return texts + ["", "a<|endoftext|>b <|endoftext|><|endoftext|> <|x", "  <|endoftext|>  x", "<|endof", "text|>"]


def test_ids_are_the_librarys(library, packed):
    texts = hard_texts()
    assert encoded(texts, packed) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_as_text(packed):
    plain = Tokenizer.from_file(backtrack.VOCABULARY)
    plain.encode_special_tokens = True
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x"]
    assert encoded(texts, packed, special=False) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_pair_may_stand_exactly_if_it_encodes_to_itself(library):
    """The pair table against merging by rank, for random pairs of tokens of one word."""
    words, pick = backtrack.vocabulary(backtrack.VOCABULARY), random.Random(3)
    letters = [k for k, token in enumerate(words.tokens) if token.isalpha() and token.isascii()]
    for _ in range(3000):
        a, b = pick.choice(letters), pick.choice(letters)
        joined = (words.tokens[a] + words.tokens[b]).decode()
        assert words.merges.may_follow(a, b) == (library.encode(joined, add_special_tokens=False).ids == [a, b])


def test_time_is_linear_in_a_long_run(packed):
    words = backtrack.vocabulary(backtrack.VOCABULARY)
    ids = words.encode_piece(b"ab" * 200_000)
    assert b"".join(words.tokens[k] for k in ids) == b"ab" * 200_000


def test_bounded_caches_change_nothing(library, packed, monkeypatch):
    monkeypatch.setattr(backtrack, "CACHED_PIECES", 50)
    monkeypatch.setattr(backtrack, "CACHED_PAIRS", 50)
    texts = hard_texts()[:500]
    assert encoded(texts, packed) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_with_offsets(documents):
    docs = documents([*ODD, (9, "x<|endoftext|>y")])
    rows = backtrack.decode(backtrack.encode(docs, ("doc_id", "text", "score"))).collect()
    assert len(rows) == len(ODD) + 1
    for row in rows:
        raw = (row.text or "").encode()
        assert row.decoded == raw
        assert [*row.ends[-1:]] == ([len(raw)] if raw else [])
        assert np.all(np.diff([0, *row.ends]) > 0)


def test_null_ids_and_clashing_names(spark, documents):
    ids = spark.createDataFrame([(1, [64, 65]), (2, None), (3, [])], "n int, ids array<int>")
    assert {r.n: r.decoded for r in backtrack.decode(ids).collect()} == {1: b"ab", 2: None, 3: b""}
    with pytest.raises(ValueError):
        backtrack.decode(ids.withColumn("decoded", F.lit(1)))
    with pytest.raises(ValueError):
        backtrack.encode(documents(ODD).withColumn("ids", F.lit(1)), ("ids",))
    assert backtrack.round_trip_digests(documents([]).limit(0)).collect() == []


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = catalog.op11_backtrack_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
