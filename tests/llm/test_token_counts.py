import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logwarden.llm import arrow, segment, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.VOCABULARY)


def counted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(library):
    pick = random.Random(4)
    letters = "'''sstdmrevl   \n\t aZ19!?.é日ß\u3000́İΣσ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(chr(pick.choice([pick.randrange(32, 0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(300)]
    texts += ["", "a<|endoftext|>b <|startoftext|><|endoftext|> <|x", " ", "<|endoftext|>"]
    got = token_counts.count_rows(arrow.texts(pa.array(texts)), token_counts.VOCABULARY, segment.packed_symbols("tokenizers"))[1].to_pylist()
    assert got == [counted(library, t) for t in texts]


@pytest.mark.parametrize("text", ["Hello world, it's  naïve's 12 x", "antidisestablishmentarianism!!!!", "日本 a\n\n b", ""])
def test_every_prefix(documents, library, text):
    row = token_counts.prefix_table(documents([(1, text)])).first()
    assert row.prefix_tokens == [counted(library, row.normalized[:k]) for k in range(len(row.normalized) + 1)]


def test_budgets_without_encoding_again(documents, library):
    table = token_counts.prefix_table(documents([(1, "some unusually worded sentence"), (2, None)]))
    for budget in (0, 1, 3, 100):
        for row in token_counts.longest_within(table, budget).collect():
            fits = [k for k in range(len(row.normalized) + 1) if counted(library, row.normalized[:k]) <= budget]
            assert row.fit_chars == max(fits)


def test_odd_rows(documents, odd, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(documents(odd)).collect())
    want = [(i or 0, len((t or "").encode()), counted(library, t or ""), counted(library, t or "") > 2048) for i, t in odd]
    assert got == sorted(want)
    assert token_counts.token_counts(documents([])).collect() == []


def test_whole_table_against_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in token_counts.token_counts(docs, keep=("doc_id", "text")).collect():
        assert row.n_tokens == counted(library, row.text)


def test_totals_come_from_the_counts_of_prefixes(monkeypatch):
    texts = arrow.texts(pa.array(["one two", "", None, "<|endoftext|>", "a <|endoftext|> b", "é日本"]))
    asked = []
    whole = token_counts.prefix_counts
    monkeypatch.setattr(token_counts, "prefix_counts", lambda *given: asked.append(whole(*given)) or asked[-1])
    packed = segment.packed_symbols("tokenizers")
    _, totals = token_counts.count_rows(texts, token_counts.VOCABULARY, packed)
    assert len(asked) == 1
    assert totals.to_pylist() == [c[-1] for c in token_counts.prefix_rows(texts, token_counts.VOCABULARY, packed)[1].to_pylist()]


def test_special_strings_within_a_chunk(library):
    """Leading, doubled and trailing ones, beside texts without, each place by the library."""
    texts = ["x", "<|endoftext|><|endoftext|>a b ", "", "a <|startoftext|> ", "<|endoftext|>", "no", " <|endoftext|> é <|endoftext|>c"]
    rows = token_counts.prefix_rows(arrow.texts(pa.array(texts)), token_counts.VOCABULARY, segment.packed_symbols("tokenizers"))
    for text, shown, counts in zip(texts, rows[0].to_pylist(), rows[1].to_pylist()):
        assert len(counts) == len(shown) + 1 and counts[-1] == counted(library, text)
    assert rows[1].to_pylist()[1] == [2, 3, 3, 4, 4]
