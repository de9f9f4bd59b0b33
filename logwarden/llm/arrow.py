"""Arrow batches of texts as flat byte arrays, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_BYTES = 1 << 18


def texts(column: pa.Array) -> pa.Array:
    """The column as large strings; null becomes empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of ``texts(column)`` with at most ``limit`` bytes, or one row if it is longer."""
    column = texts(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield column.slice(row, stop - row)
        row = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large-string array and the offsets of its rows in them."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def lists(ends: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    """A list per row from the offsets of the rows in ``values``."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def map_texts(
    docs: DataFrame, keep: list[Column], text: Column,
    fields: list[StructField], work: Callable[[pa.Array], list[pa.Array]], limit: int = CHUNK_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, and what ``work`` makes of each chunk of texts."""
    source = docs.select(*keep, text.cast("string").alias("\x01text"))
    kept = source.schema.fields[:-1]
    if {f.name.lower() for f in kept} & {f.name.lower() for f in fields}:
        raise ValueError("a kept column has the name of a result")

    def run(batches):
        for batch in batches:
            row = 0
            for chunk in chunks(batch.column(batch.num_columns - 1), limit):
                ids = [c.slice(row, len(chunk)) for c in batch.columns[:-1]]
                row += len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [*ids, *work(chunk)], names=[f.name for f in kept] + [f.name for f in fields]
                )

    return source.mapInArrow(run, StructType([*kept, *fields]))


def keep_rows(docs: DataFrame, text: str, work: Callable[[pa.Array], np.ndarray], limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, for whose texts ``work`` gives true."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                mask = np.concatenate([work(chunk) for chunk in chunks(batch.column(place), limit)])
                yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def first_labels(labels: DataFrame, flag: str, usable: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids: those of ``usable`` rows with least hash. An id with
    both labels teaches nothing and is left out. Only (doc_id, label) of these few are
    gathered, so joining with them can be done by broadcast."""
    one = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col(flag).isin(0, 1))
        .groupBy("doc_id").agg(F.min(flag).alias("label"), F.max(flag).alias("\x01most"))
        .where("label = `\x01most`")
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("label").cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, flag: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of the documents that :func:`first_labels` picks."""
    picked = F.broadcast(first_labels(labels, flag, usable, rows))
    return docs.select("doc_id", "text").join(picked, "doc_id")
