"""Vector codes: parts of a vector by the nearest entry of a small codebook, in whole numbers.

A part falls into a coarse cell of a grid. Which entries can be nearest to anything in a cell
depends on the cell alone: an entry whose least distance to the cell's box is more than the
greatest distance of another entry is never nearest. The entries that remain are remembered by
cell, and only these are compared exactly. Every round is one pass over the vectors; what
leaves a task is one sum for each entry and position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from logwarden.llm import arrow
from logwarden.operators.skew import salted_join
from logwarden.stage import written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
REACH = 1 << 27  # whole-number components below it keep all sums within 64 bits
CACHED_CELLS = 1 << 16  # of one part position
BATCH = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Memo:
    """Entries of one part position's codebook that can be nearest somewhere in a cell."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = int(np.ptp(entries, axis=0).max(initial=0)) if len(entries) else 0
        self.bits = max(0, (spread // 4).bit_length())  # a cell is a few per cent of the codebook's extent wide
        self.known: dict[int, tuple[bytes, int]] = {}

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """A bit for each entry that has to be compared, by part."""
        cells = parts >> self.bits
        powers = np.cumprod(np.full(cells.shape[1], _MIX)) if cells.shape[1] else np.zeros(0, np.uint64)
        hashes = cells.astype(np.uint64) @ powers
        hashes ^= hashes >> np.uint64(31)
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        corners = np.ascontiguousarray(cells[first])
        keys = hashes[first].tolist()
        found = [self.known.get(k) for k in keys]
        new = [k for k, f in enumerate(found) if f is None or f[0] != corners[k].tobytes()]
        masks = np.array([0 if f is None else f[1] for f in found], np.int64)
        if new:
            masks[new] = self.undominated(corners[new])
            if len(self.known) + len(new) > CACHED_CELLS:
                self.known.clear()
            self.known.update((keys[k], (corners[k].tobytes(), int(masks[k]))) for k in new)
        out = masks[of]
        other = (cells != corners[of]).any(axis=1)  # another cell of the same hash: compare all
        out[other] = (1 << len(self.entries)) - 1
        return out

    def undominated(self, corners: np.ndarray) -> np.ndarray:
        """Distances to a box add up over positions, and cells have few sides of their own at
        each, so these are worked out once."""
        least = np.zeros((len(corners), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for entries, sides in zip(self.entries.T, corners.T):
            values, at = np.unique(sides, return_inverse=True)
            low = (values << self.bits)[:, None]
            high = low + (1 << self.bits) - 1
            least += (np.maximum(np.maximum(low - entries, entries - high), 0) ** 2)[at]
            most += (np.maximum(np.abs(entries - low), np.abs(entries - high)) ** 2)[at]
        return ((least <= most.min(axis=1, initial=np.iinfo(np.int64).max)[:, None]) << np.arange(len(self.entries))).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part; of equal distances the lower entry."""
        parts = np.ascontiguousarray(parts)
        masks = self.candidates(parts)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        for k, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks >> k & 1)
            apart = (parts if len(rows) == len(parts) else parts[rows]) - entry
            distance = np.einsum("ij,ij->i", apart, apart)
            nearer = distance < best[rows]
            best[rows[nearer]], index[rows[nearer]] = distance[nearer], k
        return index, best


def whole_numbers(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, cells) of the rows whose vector is there and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    far = F.exists(scaled, lambda x: F.abs(x) >= REACH)
    message = F.lit(f"a component is beyond {REACH // SCALE}")
    cells = F.when(far, F.raise_error(message).cast("array<int>")).otherwise(scaled.cast("array<int>"))
    return embeddings.where(F.col(vector).isNotNull() & ~bad).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), cells.alias("cells"))


def _arrays(column: pa.Array, width: int) -> np.ndarray:
    """Rows as parts: (row, part, position)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def _assigned(parts: np.ndarray, memos: list[Memo]) -> tuple[np.ndarray, np.ndarray]:
    found = [memo.nearest(parts[:, k]) for k, memo in enumerate(memos)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(numbers: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Number and sum of the parts nearest to each entry, a row for each position."""
    parts_of, entries, width = codebooks.shape
    shape = StructType([
        StructField("part", IntegerType()), StructField("entry", IntegerType()), StructField("n", LongType()),
        StructField("sums", ArrayType(LongType())),
    ])

    def run(batches):
        memos = [Memo(book) for book in codebooks]
        n, total = np.zeros((parts_of, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for row in range(0, batch.num_rows, BATCH):
                parts = _arrays(batch.column(0).slice(row, BATCH), width)
                nearest, _ = _assigned(parts, memos)
                for k in range(parts_of):
                    n[k] += np.bincount(nearest[:, k], minlength=entries)
                    np.add.at(total[k], nearest[:, k], parts[:, k])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
            arrow.lists(np.arange(len(part) + 1) * width, total[part, entry].ravel()),
        ], names=shape.names)

    return (
        numbers.select("cells").mapInArrow(run, shape)
        .select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    )


def trained(numbers: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, position) of :func:`whole_numbers`. They start as the vectors of
    least ids, of equal ids those with the lesser components; null ids come last."""
    sizes = numbers.agg(F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most")).first()
    if sizes.least is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    if sizes.least != sizes.most or sizes.least % PARTS:
        raise ValueError(f"vectors must be equally long, a multiple of {PARTS}")
    first = numbers.orderBy(F.asc_nulls_last("vec_id"), "cells").limit(entries).collect()
    width = sizes.least // PARTS
    books = np.array([r.cells for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(numbers, books).collect():  # at most one number for each entry and position
            books[r.part, r.entry, r.place] = r.value // r.n
    return books


def coded(numbers: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``numbers`` without its cells, with ``code`` and ``error``."""
    width = codebooks.shape[2]
    source = numbers.select("vec_id", "label", "cells")
    fields = [*source.schema.fields[:-1], StructField("code", StringType()), StructField("error", LongType())]

    def run(batches):
        memos = [Memo(book) for book in codebooks]
        for batch in batches:
            for row in range(0, batch.num_rows, BATCH):
                part = batch.slice(row, BATCH)
                nearest, apart = _assigned(_arrays(part.column(2), width), memos)
                shown = nearest.astype(np.uint8).tobytes().hex()
                codes = [shown[k:k + 2 * PARTS] for k in range(0, len(shown), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(codes, pa.string()), pa.array(apart.sum(axis=1))], names=[f.name for f in fields]
                )

    return source.mapInArrow(run, StructType(fields))


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``codes`` with ``approximate array<double>``: the vector that each code stands for."""
    books = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in codebooks))
    at = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    parts = F.flatten(F.array(*(F.get(F.get(books, k), at(k)) for k in range(PARTS))))
    return codes.withColumn("approximate", F.transform(parts, lambda x: (x + 0.5) / SCALE))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every row with a
    usable vector. A null vector, or one with a null or non-finite component, has no row; null ids
    and labels are kept (null labels are one label); repeated rows are coded each; an empty
    table gives none. Fewer vectors than entries make smaller codebooks. Vectors that differ in
    length, or have one that is no multiple of eight, are refused, and so are components from
    32,768 on. Other columns do not matter."""
    numbers = written(whole_numbers(embeddings))
    books = trained(numbers)
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    codes = written(coded(numbers, books).withColumn("\x01label", name))
    totals = codes.groupBy("\x01label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = salted_join(codes, totals.drop("n"), "\x01label", totals.select("\x01label", "n"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    apart = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """x AS MATERIALIZED (
  SELECT r, p, c[CAST(p * (len(c) // 8) + 1 AS BIGINT) : CAST((p + 1) * (len(c) // 8) AS BIGINT)] AS v FROM kept, range(8) AS t(p))""",
        """b0 AS MATERIALIZED (
  SELECT p, k - 1 AS e, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, c) AS k FROM kept) USING (r) WHERE k <= 16)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, e, d FROM (
    SELECT x.r, x.p, b.e, CAST({apart} AS BIGINT) AS d FROM x JOIN b{k} AS b ON b.p = x.p)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} AS b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{k} JOIN x USING (r, p))
      GROUP BY p, e, i)
    GROUP BY p, e) AS n USING (p, e))""")
    steps.append(f"""books AS (
  SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM b{ROUNDS}))""")
    steps.append(f"""codes AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), books"""


ORACLE = _oracle()
