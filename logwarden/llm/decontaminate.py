"""Benchmark decontamination by Wu-Manber search for many patterns at once.

A pattern is a window of benchmark words, a symbol is a word, and a block is the last two
words of a position. The shift table says how far the search may jump behind a block: past
every position at which no pattern can end. Where the shift is zero, the hash of the block
leads to the patterns with that ending, of which a hash of all their words picks the one to
compare; comparing bytes confirms an occurrence. A window that items share is one pattern.
Texts are cut into stretches whose searches advance side by side.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from logwarden.llm import arrow
from logwarden.llm.words import BASE, SPACE, Words, words_of
from logwarden.stage import written

WINDOW = 10
BLOCK_BYTES = 1 << 20  # benchmark text searched for in one pass
STRETCH = 256  # words that one search walks through

FOLD = np.full(256, SPACE, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def block_hash(words: Words, ends: np.ndarray, length: int) -> np.ndarray:
    """Of the last two words (of one-word patterns, the word) at each position."""
    if length == 1:
        return words.hashes[ends]
    out = words.hashes[ends - 1] * BASE + words.hashes[ends]
    return out ^ out >> np.uint64(31)


def window_hash(words: Words, firsts: np.ndarray, length: int) -> np.ndarray:
    """Of the ``length`` words from each position."""
    out = np.zeros(len(firsts), np.uint64)
    for k in range(length):
        out = out * BASE + words.hashes[firsts + k]
    return out


class Patterns(NamedTuple):
    """Distinct windows of one length."""

    length: int
    bits: int
    shift: np.ndarray  # by leading bits of a block's hash
    endings: np.ndarray  # distinct hashes of last blocks, sorted
    bucket: np.ndarray  # offsets of the endings in the windows
    whole: np.ndarray  # a window's hash, sorted within a bucket
    places: np.ndarray  # where a window's bytes begin and end in the text
    owned: np.ndarray  # offsets of the windows in the owners
    owners: np.ndarray  # the items that have a window


class Tables(NamedTuple):
    text: bytes
    items: list
    groups: list[Patterns]


def tables_of(rows: list[tuple[str | None, str | None]], window: int) -> Tables:
    """Search tables of benchmark items (id, text)."""
    words = words_of(arrow.texts(pa.array([text for _, text in rows], pa.string())), FOLD)
    counts = np.diff(words.rows)
    groups = []
    for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        mine = np.flatnonzero(np.minimum(counts, window) == length)
        many = counts[mine] - length + 1
        first = np.repeat(words.rows[mine] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        block = min(2, length)
        bits = max(8, int(len(first) * length * 8).bit_length())
        shift = np.full(1 << bits, length - block + 1, np.uint8)
        for place in range(block, length + 1):
            spots = (block_hash(words, first + place - 1, length) >> np.uint64(64 - bits)).astype(np.int64)
            shift[spots] = np.minimum(shift[spots], length - place)
        number: dict[bytes, int] = {}
        which = np.array([
            number.setdefault(words.text[a:b], len(number)) for a, b in zip(words.places[first].tolist(), words.places[first + length].tolist())
        ])
        first, owner = first[np.unique(which, return_index=True)[1]], np.repeat(mine, many)
        last, whole = block_hash(words, first + length - 1, length), window_hash(words, first, length)
        order = np.lexsort((whole, last))
        endings, begin = np.unique(last[order], return_index=True)
        places = np.stack([words.places[first], words.places[first + length]], 1)[order]
        pairs = np.unique(np.stack([np.argsort(order)[which], owner]), axis=1)
        owned = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        groups.append(Patterns(length, bits, shift, endings, np.r_[begin, len(first)], whole[order], places, owned, pairs[1]))
    return Tables(words.text, [item for item, _ in rows], groups)


def occurrences(words: Words, patterns: Patterns, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First words of the occurrences, and the windows that occur there."""
    n, m = len(words.hashes), patterns.length
    at = np.arange(m - 1, n, STRETCH)
    stop = np.minimum(at + STRETCH, n)
    found = [np.zeros(0, np.int64)]
    while len(at):
        shift = patterns.shift[(block_hash(words, at, m) >> np.uint64(64 - patterns.bits)).astype(np.int64)]
        found.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    ends = np.concatenate(found)
    last = block_hash(words, ends, m)
    bucket = np.minimum(np.searchsorted(patterns.endings, last), max(len(patterns.endings) - 1, 0))
    row = np.searchsorted(words.rows, [ends - m + 1, ends], "right")
    good = (patterns.endings[bucket] == last) & (row[0] == row[1])  # within one text
    ends, bucket = ends[good], bucket[good]
    begins = ends - m + 1
    low, behind, hash = patterns.bucket[bucket], patterns.bucket[bucket + 1], window_hash(words, begins, m)
    high = behind
    while (low < high).any():  # the first window of the bucket with that hash
        middle = np.minimum((low + high) // 2, len(patterns.whole) - 1)
        right = (low < high) & (patterns.whole[middle] < hash)
        low, high = np.where(right, middle + 1, low), np.where(right, high, np.minimum(high, middle))
    on = np.flatnonzero((low < behind) & (patterns.whole[np.minimum(low, len(patterns.whole) - 1)] == hash))
    found = []
    for k, p, stop, a, b in zip(
        on.tolist(), low[on].tolist(), behind[on].tolist(), words.places[begins[on]].tolist(), words.places[begins[on] + m].tolist()
    ):
        window = words.text[a:b]
        while p < stop and patterns.whole[p] == hash[k]:
            first, last = patterns.places[p]
            if text[first:last] == window:
                found.append((begins[k], p))
                break
            p += 1
    return np.array(found, np.int64).reshape(-1, 2).T


def search(column: pa.Array, spans: pa.Array, found: pa.Array, tables: Tables) -> list[pa.Array]:
    """Word counts, hit stretches (first word, word behind) and item ids of each row; to
    the stretches and ids of an earlier pass new ones are added."""
    words = words_of(column, FOLD)
    n, rows = len(words.hashes), len(column)
    cover = np.zeros(n + 1, np.int64)
    earlier = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.repeat(words.rows[:-1], np.asarray(spans.value_lengths()) if rows else [])
    np.add.at(cover, earlier[::2] + base[::2], 1)
    np.add.at(cover, earlier[1::2] + base[1::2], -1)
    hits = [np.zeros((2, 0), np.int64)]
    for patterns in tables.groups:
        first, window = occurrences(words, patterns, tables.text)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + patterns.length, -1)
        row, window = np.unique(np.stack([np.searchsorted(words.rows, first, "right") - 1, window]), axis=1)
        many = patterns.owned[window + 1] - patterns.owned[window]
        owner = np.repeat(patterns.owned[window] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        hits.append(np.stack([np.repeat(row, many), patterns.owners[owner]]))
    hit = np.cumsum(cover)[:n] > 0
    edge = np.zeros(n + 1, bool)
    edge[words.rows] = True
    before = np.r_[False, hit]
    opens = np.flatnonzero(hit & (~before[:-1] | edge[:-1]))
    closes = np.flatnonzero(before[1:] & (edge[1:] | ~np.r_[hit[1:], False])) + 1
    owner = np.searchsorted(words.rows, opens, "right") - 1
    pairs = (np.stack([opens, closes], 1) - words.rows[owner][:, None]).astype(np.int32)
    ends = np.searchsorted(owner, np.arange(rows + 1)) * 2
    named: list[set] = [set(x) for x in found.to_pylist()]
    for row, item in np.unique(np.concatenate(hits, 1), axis=1).T.tolist():
        if tables.items[item] is not None:
            named[row].add(tables.items[item])
    sums = np.r_[0, np.cumsum(hit)][words.rows]
    return [
        pa.array(np.diff(words.rows)), pa.array(np.diff(sums)), arrow.lists(ends, pairs.ravel()),
        pa.array([sorted(x) for x in named], pa.list_(pa.string())),
    ]


FOUND = [
    StructField("n_words", LongType()), StructField("n_hit", LongType()),
    StructField("spans", ArrayType(IntegerType())), StructField("items", ArrayType(StringType())),
]


def _pass(docs: DataFrame, tables: Tables) -> DataFrame:
    """One block of the benchmark against all rows of (\x01text, ..., spans, items)."""
    fields = docs.schema.fields[:-4]

    def run(batches):
        for batch in batches:
            row = 0
            for chunk in arrow.chunks(batch.column(0)):
                part = batch.slice(row, len(chunk))
                row += len(chunk)
                made = search(chunk, part.column(part.num_columns - 2), part.column(part.num_columns - 1), tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-4], *made], names=[f.name for f in fields] + [f.name for f in FOUND]
                )

    return docs.mapInArrow(run, StructType([*fields, *FOUND]))


def blocks(benchmark: DataFrame, window: int):
    """(is it the last, search tables) of blocks of items with about ``BLOCK_BYTES`` of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    for block in range(count):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block
        rows = benchmark.where(mine).select(F.col("item_id").cast("string"), "text").collect()
        yield block + 1 == count, tables_of([tuple(r) for r in rows], window)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """For every row the ``keep`` columns, ``n_words``, ``n_hit`` (words in an occurrence of
    a benchmark window), ``spans`` (stretches of hit words: first, behind the last, and so
    on) and ``items`` (ids, as sorted strings, with a window in the text).

    Null and empty texts have no words. Items without words are never found; an item without
    an id marks words but is not listed; rows that share an id count as one item. Texts and
    items are searched whole. The benchmark is dealt out into blocks of about
    ``BLOCK_BYTES`` that are searched for one after the other, in as many passes as its
    size takes, so what executors hold at once does not grow with it. Kept columns with the
    name of a result are refused.
    """
    if {c.lower() for c in keep} & {f.name for f in FOUND}:
        raise ValueError("a kept column has the name of a result")
    empty = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
             F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")]
    state = docs.select(F.col(text).cast("string").alias("\x01text"), *keep, *empty)
    for last, tables in blocks(benchmark, window):
        state = _pass(state, tables)
        state = state if last else written(state)
    return state.drop("\x01text")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without an occurrence of any benchmark window."""
    for last, tables in blocks(benchmark, window):

        def clean(column, tables=tables):
            spans = pa.array([[]] * len(column), pa.list_(pa.int32()))
            items = pa.array([[]] * len(column), pa.list_(pa.string()))
            return search(column, spans, items, tables)[1].to_numpy() == 0

        docs = arrow.keep_rows(docs, text, clean)
        docs = docs if last else written(docs)
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and a digest of the items, by document."""
    return benchmark_hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
p AS (
    SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
          FROM b WHERE len(w) > 0)),
g AS (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))),
o AS (SELECT DISTINCT r, i, g.m, item FROM g JOIN p ON g.g = p.g AND g.m = p.m),
h AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM o) GROUP BY r),
n AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
