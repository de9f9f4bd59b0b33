import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from logwarden.llm import arrow, bpe, segment


@pytest.fixture(scope="module")
def library():
    ranks = bpe.vocabulary(bpe.VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    out = []
    for chunk in arrow.chunks(pa.array(texts, pa.string()), 5000):
        out += bpe.encode_rows(chunk, bpe.VOCABULARY)[0].to_pylist()
    return out


def test_ids_are_the_librarys(library):
    pick = random.Random(1)
    letters = "'''sstdmrevl   \n\t aZ19!?.é日ß\u3000́\u1c89"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(pick.choice([pick.randrange(32, 0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(300)]
    texts += ["", " ", "a" * 5000 + "'re" * 300, "x" + " " * 400, "<|endoftext|>", "'", "''s", " 's", "\n's"]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_states_by_scan_are_those_of_one_step_after_the_other():
    import numpy as np

    for lead in (True, False):
        symbols = np.random.default_rng(2).integers(0, segment.SYMBOLS, 5000).astype(np.uint8)
        got, state = segment.states_before(symbols, segment.automaton(lead)), segment.START
        for k, symbol in enumerate(symbols.tolist()):
            assert got[k] == state
            state = segment.next_state(state, symbol, lead)


def test_odd_rows_round_trip(documents, odd, library):
    rows = bpe.round_trip_digests(documents(odd)).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for i, text in odd:
        ids = library.encode_ordinary(text or "")
        digests = (hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode()))
        want.append((i or 0, len(ids), *digests))
    assert got == sorted(want)
    assert bpe.round_trip_digests(documents([])).collect() == []


def test_offsets_are_ends_of_tokens(documents):
    row = bpe.encode(documents([(1, "naïve 日本 don't")])).first()
    words = bpe.vocabulary(bpe.VOCABULARY)
    begin = 0
    for token, end in zip(row.ids, row.ends):
        assert words.tokens[token] == "naïve 日本 don't".encode()[begin:end]
        begin = end
    wrong = bpe.encode(documents([(1, "some words")])).selectExpr("doc_id", "ids", "transform(ends, e -> e + 1) AS ends")
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe.decode(wrong).collect()


def test_whole_table_against_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in bpe.encode(docs, keep=("doc_id", "text")).collect():
        assert row.ids == library.encode_ordinary(row.text)
