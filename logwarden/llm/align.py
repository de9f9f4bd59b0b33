"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked.

Tokens of A and B are cut into groups where both end at the same byte. A stretch of a text is
a fragment: what precedes its first common end (open prefix), the groups between common ends,
and what follows the last one (open suffix). Fragments of neighbouring stretches compose: the
suffix of the left one and the prefix of the right one become a group between them. Composing
is associative, so the fragments of a very long text are put together as a tree across tasks;
a text of one stretch is done in the task that reads it.

Counts of linked id pairs are corpus-wide. The most frequent pairs, a bounded number, travel to
the tasks; the rest, which no text shares with many others, is joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from logwarden.llm import arrow, backtrack, segment
from logwarden.stage import written

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
STRETCH = 1 << 16  # bytes of a text that make one fragment
FAN_IN = 8  # fragments composed at once
FREQUENT = 1 << 20  # pairs whose counts travel to the tasks
SHIFT = 32  # a pair is one number: A's id, then B's
LARGE = 256  # links of a group from which equal ids are added up first


class Fragment(NamedTuple):
    """Ids of both sides in order, and after how many of them each common end lies. What
    precedes the first common end and what follows the last is open."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    @property
    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.a[:self.a_cuts[0]], self.b[:self.b_cuts[0]]) if len(self.a_cuts) else (self.a, self.b)

    @property
    def suffix(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.a[self.a_cuts[-1]:], self.b[self.b_cuts[-1]:]) if len(self.a_cuts) else (self.a, self.b)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """Of the tokens that end in one stretch of bytes."""
    _, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    return Fragment(a, b, a_at + 1, b_at + 1)


def compose(parts: Iterable[Fragment]) -> Fragment:
    """Of neighbouring stretches in order: cuts of the left stay where they are, those of the
    right lie behind the left's tokens, so the left's open suffix and the right's open
    prefix meet in one group."""
    parts = list(parts)
    before = lambda side: np.cumsum([0, *(len(p[side]) for p in parts[:-1])])
    return Fragment(
        np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]),
        np.concatenate([p.a_cuts + k for p, k in zip(parts, before(0))]),
        np.concatenate([p.b_cuts + k for p, k in zip(parts, before(1))]),
    )


class Pieces:
    """The piece vocabulary, and the bytes of its pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = backtrack.Offsets([self._bytes(k) for k in range(self.model.vocab_size())])

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Sides(NamedTuple):
    """Tokens of a chunk of texts on both sides, those of texts without tokens left out."""

    a: np.ndarray
    a_rows: np.ndarray  # offsets of the rows
    a_ends: np.ndarray  # byte at which each token ends, rows one behind the other
    b: np.ndarray
    b_rows: np.ndarray
    b_ends: np.ndarray
    bytes_at: np.ndarray  # where each row's bytes begin


def both_sides(column: pa.Array, first: str, second: str, packed: bytes) -> Sides:
    """Both encodings of the space and each text."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    words, model = backtrack.vocabulary(first), pieces(second)
    a, a_rows = backtrack.encode_rows(spaced, first, packed, special=False)
    found = model.model.encode(column.to_pylist(), num_threads=1)
    b_counts = np.fromiter(map(len, found), np.int64, len(found))
    b_rows = np.r_[0, np.cumsum(b_counts)]
    b = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(b_rows[-1]))
    data, rows = arrow.flat(spaced)
    raw, lengths = data.tobytes(), np.diff(rows)
    fine = lengths > 1
    for table, ids, offsets in ((words.bytes, a, a_rows), (model.bytes, b, b_rows)):
        joined, ends = table.joined(ids)
        cut, joined = np.r_[0, ends][offsets].tolist(), joined.tobytes()
        same = [joined[p:q] == raw[x:y] for p, q, x, y in zip(cut, cut[1:], rows.tolist(), rows[1:].tolist())]
        fine &= np.array(same, bool)
    kept = []
    for ids, offsets in ((a, a_rows), (b, b_rows)):
        ids = ids[np.repeat(fine, np.diff(offsets))]
        kept += [ids, np.r_[0, np.cumsum(np.diff(offsets) * fine)]]
    bytes_at = np.r_[0, np.cumsum(lengths * fine)]
    a, a_rows, b, b_rows = kept
    return Sides(a, a_rows, np.cumsum(words.bytes.widths[a]), b, b_rows, np.cumsum(model.bytes.widths[b]), bytes_at)


def group_text(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, first: str, second: str) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all groups one behind the other, a mark behind each token, and
    where A's tokens of each group begin in it. Every group has tokens of both sides."""
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    a_first, b_first = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
    order = np.empty(len(a) + len(b), np.int64)  # numbers in one table of labels, A's first
    a_place = np.arange(len(a)) + b_first[a_group]
    b_place = np.arange(len(b)) + a_first[b_group + 1]
    order[a_place], order[b_place] = a, b.astype(np.int64) + len(backtrack.vocabulary(first).tokens)
    both = _labels(first, second)
    shown, ends = both.joined(order)
    shown[ends[a_place[a_first[1:] - 1]] - 1] = ord("|")
    shown[ends[b_place[b_first[1:] - 1]] - 1] = ord(";")
    starts = np.r_[0, ends][a_first + b_first]
    return shown.tobytes(), starts


@lru_cache(maxsize=2)
def _labels(first: str, second: str) -> backtrack.Offsets:
    words, model = backtrack.vocabulary(first), pieces(second)
    return backtrack.Offsets([b"%d," % k for k in range(len(words.tokens))] + [b"%d," % k for k in range(model.model.vocab_size())])


def links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, pair) of linked ids and how many links each stands for, by row.
    ``owner``: the row of each group. Of a group with many links, equal ids are added up
    before they are paired, so a run of one token against a run of another is one pair."""
    groups = len(owner)
    a_n, b_n = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    out = [_paired(a, b, a_group, b_group, a_n * b_n < LARGE)]
    sizes = [int(x.max(initial=0)).bit_length() for x in (owner, a, b)]
    if sum(sizes) < 64 and not (a_n * b_n >= LARGE).any():  # every link is one row, which fits one number
        group, keys, _ = out[0]
        left, right = sizes[1:]
        whole = np.sort(owner[group] << (left + right) | (keys >> SHIFT) << right | keys & (1 << SHIFT) - 1)
        first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.zeros(0, np.int64)
        keys = whole[first]
        pairs = (keys >> right & (1 << left) - 1) << SHIFT | keys & (1 << right) - 1
        return keys >> (left + right), pairs, np.diff(np.r_[first, len(whole)])
    for g in np.flatnonzero(a_n * b_n >= LARGE).tolist():
        x, x_times = np.unique(a[slice(*np.searchsorted(a_group, (g, g + 1)))], return_counts=True)
        y, y_times = np.unique(b[slice(*np.searchsorted(b_group, (g, g + 1)))], return_counts=True)
        keys = (x.astype(np.int64)[:, None] << SHIFT | y).ravel()
        out.append((np.full(len(keys), g), keys, np.outer(x_times, y_times).ravel()))
    group, keys, times = (np.concatenate(c) for c in zip(*out))
    rows = owner[group]
    order = np.lexsort((keys, rows))
    rows, keys, times = rows[order], keys[order], times[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.add.reduceat(times, first) if len(first) else times


def _paired(
    a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, wanted: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every A token of a wanted group with every B token of it."""
    fine, groups = wanted[a_group], len(wanted)
    left, group = a[fine].astype(np.int64), a_group[fine]
    b_first = np.searchsorted(b_group, np.arange(groups + 1))
    repeats = np.diff(b_first)[group]
    ends = np.cumsum(repeats)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b_first[group] - (ends - repeats), repeats)
    keys = np.repeat(left, repeats) << SHIFT | b[at]
    return np.repeat(group, repeats), keys, np.ones(len(keys), np.int64)


_NUMBERS = ArrayType(LongType())
_WHOLE = [
    StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()),
    StructField("n_links", LongType()), StructField("groups_sha256", StringType()),
    StructField("pairs", _NUMBERS), StructField("times", _NUMBERS),
]
_PART = [StructField("part", IntegerType()), StructField("parts", IntegerType())]
_FRAGMENT = [StructField(name, ArrayType(IntegerType())) for name in ("a", "b", "a_cuts", "b_cuts")]


def closed(whole: Fragment, rows: np.ndarray, first: str, second: str) -> list[pa.Array]:
    """Columns of ``_WHOLE`` for texts one behind the other, all of whose tokens are closed.
    ``rows``: offsets of the texts in the groups."""
    a_group = np.searchsorted(whole.a_cuts, np.arange(len(whole.a)), "right")
    b_group = np.searchsorted(whole.b_cuts, np.arange(len(whole.b)), "right")
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    at, keys, times = links(whole.a, whole.b, a_group, b_group, owner)
    offsets = np.searchsorted(at, np.arange(n + 1))
    shown, starts = group_text(whole.a, whole.b, a_group, b_group, first, second)
    cut = starts[rows].tolist()
    digests = [hashlib.sha256(shown[p:q - 1]).hexdigest() if q > p else "" for p, q in zip(cut, cut[1:])]
    total = np.r_[0, np.cumsum(times)]
    return [
        pa.array(np.diff(np.r_[0, whole.a_cuts][rows]), pa.int64()), pa.array(np.diff(np.r_[0, whole.b_cuts][rows]), pa.int64()),
        pa.array(np.diff(rows), pa.int64()), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()),
        pa.array(digests, pa.string()), arrow.lists(offsets, keys), arrow.lists(offsets, times.astype(np.int64)),
    ]


def _nulls(n: int, kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.nulls(n, kind) for kind in kinds]


_WHOLE_KINDS = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_FRAGMENT_KINDS = [pa.list_(pa.int32())] * 4


def _stretches(docs: DataFrame, keep: list[str], text: str, first: str, second: str, stretch: int) -> DataFrame:
    """Per text shorter than a stretch its row, finished; per stretch of another its fragment."""
    packed = segment.packed_symbols("tokenizers")
    kept = [F.col(c) for c in keep] + [F.monotonically_increasing_id().alias("\x01row"), F.col(text).cast("string").alias("\x01text")]
    source = docs.select(*kept)
    fields = source.schema.fields[:-1] + _PART + _FRAGMENT + _WHOLE
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            row = 0
            for chunk in arrow.chunks(batch.column(batch.num_columns - 1)):
                ids = [c.slice(row, len(chunk)) for c in batch.columns[:-1]]
                row += len(chunk)
                long = np.diff(arrow.flat(chunk)[1]) >= stretch
                for k in np.flatnonzero(long).tolist():
                    yield _parts(both_sides(chunk.slice(k, 1), first, second, packed), [c.slice(k, 1) for c in ids], stretch, names)
                short = pa.array(~long)
                sides = both_sides(chunk.filter(short), first, second, packed)
                whole = fragment(sides.a, sides.a_ends, sides.b, sides.b_ends)
                rows = np.searchsorted(sides.a_ends[whole.a_cuts - 1], sides.bytes_at, "right")
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays(
                    [*(c.filter(short) for c in ids), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)),
                     *_nulls(n, _FRAGMENT_KINDS), *closed(whole, rows, first, second)], names=names,
                )

    return source.mapInArrow(run, StructType(fields))


def _parts(sides: Sides, ids: list[pa.Array], stretch: int, names: list[str]) -> pa.RecordBatch:
    """The fragments of one text: tokens by the stretch of bytes in which they end. A text
    without tokens has one, which is empty."""
    parts = max(1, -(-int(sides.bytes_at[-1]) // stretch))
    bounds = np.minimum(np.arange(1, parts + 1) * stretch, sides.bytes_at[-1])
    a_at = np.r_[0, np.searchsorted(sides.a_ends, bounds, "right")]
    b_at = np.r_[0, np.searchsorted(sides.b_ends, bounds, "right")]
    pieces_of = [
        fragment(sides.a[p:q], sides.a_ends[p:q], sides.b[x:y], sides.b_ends[x:y])
        for p, q, x, y in zip(a_at, a_at[1:], b_at, b_at[1:])
    ]
    columns = [pa.array([f[k] for f in pieces_of], pa.list_(pa.int32())) for k in range(4)]
    return pa.RecordBatch.from_arrays(
        [*(c.take(pa.array([0] * parts)) for c in ids), pa.array(range(parts), pa.int32()), pa.array([parts] * parts, pa.int32()),
         *columns, *_nulls(parts, _WHOLE_KINDS)], names=names,
    )


def _read_fragment(table: pa.Table, row: int) -> Fragment:
    return Fragment(*(table.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("a", "b", "a_cuts", "b_cuts")))


def _tree(fragments: DataFrame, first: str, second: str) -> DataFrame:
    """(row, columns of ``_WHOLE``) of texts that came in fragments: neighbours are composed
    ``FAN_IN`` at a time, each such group a task's work of its own, until one is left."""
    many = fragments.agg(F.max("parts")).first()[0]
    shape = StructType([StructField("\x01row", LongType()), StructField("part", IntegerType()), *_FRAGMENT])

    def composed(key, table):
        order = np.argsort(table.column("part").to_numpy())
        whole = compose(_read_fragment(table, k) for k in order.tolist())
        lists = [pa.array([x], pa.list_(pa.int32())) for x in whole]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), *lists], names=shape.names)

    level = fragments.select(*shape.names)
    while many > 1:
        level = level.groupBy("\x01row", F.floor(F.col("part") / FAN_IN).cast("int").alias("\x01at")).applyInArrow(composed, shape)
        many = -(-many // FAN_IN)
    out = StructType([StructField("\x01row", LongType()), *_WHOLE])

    def finished(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k in range(batch.num_rows):
                whole = _read_fragment(table, k)
                columns = closed(whole, np.array([0, len(whole.a_cuts)]), first, second)
                yield pa.RecordBatch.from_arrays([table.column("\x01row")[k:k + 1].cast(pa.int64()).combine_chunks(), *columns], names=out.names)

    return level.mapInArrow(finished, out)


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more. Counts are taken in
    steps of an eighth of a power of two, so the driver sees a few hundred numbers."""
    step = F.when(F.col("n") < 16, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 1000)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for row in sorted(steps, key=lambda r: -r.least):
        total += row.pairs
        if total > most:
            break
        least = row.least
    return least


def aligned(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", first: str = FIRST, second: str = SECOND,
    stretch: int = STRETCH,
) -> DataFrame:
    """``keep`` columns, a number ``\\x01row`` for each row, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``, and the distinct linked id pairs (``A << 32 | B``) with their number of
    links (``pairs``, ``times``), as a written table. Repeated rows are rows of their own. Null and
    empty texts, and texts that either side does not give back byte by byte, have no tokens:
    zeros, empty lists and an empty digest."""
    reserved = {f.name for f in (*_PART, *_FRAGMENT, *_WHOLE)} | {"\x01row", "\x01text"}
    if reserved & {c.lower() for c in keep}:
        raise ValueError("a kept column has the name of a result")
    table = written(_stretches(docs, list(keep), text, first, second, stretch))
    short = table.where("n_a IS NOT NULL").drop("part", "parts", *(f.name for f in _FRAGMENT))
    pieces_of = table.where("n_a IS NULL")
    if pieces_of.isEmpty():
        return short
    names = pieces_of.where("part = 0").select(*keep, F.col("\x01row"))
    return short.unionByName(names.join(written(_tree(pieces_of, first, second)), "\x01row"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, is_best): in how many rows of :func:`aligned` each pair is linked, and whether
    no other pair of its A id is in more."""
    counts = written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    side = F.shiftright("pair", SHIFT).alias("\x01a")
    best = counts.groupBy(side).agg(F.max("n").alias("\x01best"))  # a row per id of A's vocabulary
    return counts.join(F.broadcast(best), side == F.col("\x01a")).select("pair", "n", (F.col("n") == F.col("\x01best")).alias("is_best"))


def linked(table: DataFrame, counts: DataFrame, keep: list[str], frequent: int = FREQUENT) -> DataFrame:
    """``keep`` columns of ``table``, ``n_best`` and ``count_sum``."""
    spark = table.sparkSession
    counts = written(counts)
    least = _threshold(counts, frequent)
    head = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy()[order] for c in ("pair", "n", "is_best")))
    tail = counts.where(F.col("n") < least)
    if tail.isEmpty():
        return _added(table, known, keep, False).drop("rest_pairs", "rest_times")
    added = written(_added(table, known, [*keep, "\x01row"], True))
    rest = added.select("\x01row", F.explode(F.arrays_zip("rest_pairs", "rest_times")).alias("x"))
    rest = rest.select("\x01row", F.col("x.rest_pairs").alias("pair"), F.col("x.rest_times").alias("m")).join(tail, "pair")
    sums = rest.groupBy("\x01row").agg(
        F.sum(F.when(F.col("is_best"), F.col("m")).otherwise(0)).alias("\x01best"), F.sum(F.col("m") * F.col("n")).alias("\x01sum")
    )
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return added.join(sums, "\x01row", "left").select(*keep, plus("n_best", "\x01best"), plus("count_sum", "\x01sum"))


def _added(table: DataFrame, known, keep: list[str], rest: bool) -> DataFrame:
    """Sums over the frequent pairs of each row, and the pairs that are not among them."""
    source = table.select(*keep, "pairs", "times")
    more = [
        StructField("n_best", LongType()), StructField("count_sum", LongType()),
        StructField("rest_pairs", _NUMBERS), StructField("rest_times", _NUMBERS),
    ]
    fields = source.schema.fields[:-2] + more

    def run(batches):
        keys, n, best = known.value
        for batch in batches:
            pairs, times = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[-2:])
            sizes = batch.column(batch.num_columns - 2).value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = np.zeros(len(pairs), np.int64)
            bests = np.zeros(len(pairs), np.int64)
            sums[there] = times[there] * n[at[there]]
            bests[there] = times[there] * best[at[there]]
            totals = [np.diff(np.r_[0, np.cumsum(x)][offsets]) for x in (bests, sums)]
            cut = np.r_[0, np.cumsum(~there)][offsets] if rest else np.zeros(len(offsets), np.int64)
            left = ~there if rest else np.zeros(len(pairs), bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *(pa.array(x, pa.int64()) for x in totals), arrow.lists(cut, pairs[left]), arrow.lists(cut, times[left])],
                names=[f.name for f in fields],
            )

    return source.mapInArrow(run, StructType(fields))


_KEPT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def alignment(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", first: str = FIRST, second: str = SECOND,
    stretch: int = STRETCH, frequent: int = FREQUENT,
) -> DataFrame:
    """Per row of ``docs``: ``keep`` columns, numbers of tokens, groups and links, ``n_best`` (links
    whose pair is in as many rows as any pair of its A id), ``count_sum`` (rows with the pair,
    summed over links) and ``groups_sha256``. For odd texts see :func:`aligned`."""
    table = aligned(docs, keep, text, first, second, stretch)
    return linked(table, pair_counts(table), [*keep, *_KEPT], frequent).select(
        *keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
