"""Reading log files onward from a bookmark, in batch and as a stream.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("files", tail_files(files, bookmarks)).load()

In batch the ranges of bytes to read are themselves a table, made of the listing and the
bookmarks. Each task seeks to its ranges and reads on from there, so only new bytes are
touched. Only whole lines count: an unterminated last line waits for its line feed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logwarden.sources.files import end_of_last_line, expand, file_length, open_filesystem
from logwarden.sources.logs import list_logs
from logwarden.stage import written

RANGE_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
MOST_TASKS = 100_000
SCHEMA = "entry string, path string, byte_offset bigint, end_offset bigint, line string"
ARROW_SCHEMA = pa.schema(
    [("entry", pa.string()), ("path", pa.string()), ("byte_offset", pa.int64()), ("end_offset", pa.int64()), ("line", pa.string())]
)


class ByteRange(InputPartition):
    """Lines that begin in [begin, end); the first range of a file begins on a line."""

    def __init__(self, path: str, begin: int, end: int, limit: int, aligned: bool, entry: str | None = None):
        self.path, self.begin, self.end, self.limit, self.aligned, self.entry = path, begin, end, limit, aligned, entry


def byte_ranges(path: str, begin: int, limit: int, entry: str | None = None) -> list[ByteRange]:
    """Ranges of bounded size that cover a file from a bookmark to its last whole line."""
    cuts = [*range(begin, limit, RANGE_BYTES), limit]
    return [ByteRange(path, a, b, limit, a == begin, entry) for a, b in zip(cuts, cuts[1:], strict=False)]


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    system, inside = open_filesystem(part.path)
    with system.open_input_file(inside) as file:
        # One byte earlier: a line that begins exactly here is told from a cut one.
        position = part.begin if part.aligned else part.begin - 1
        file.seek(position)
        skipping, rest = not part.aligned, b""
        while position < part.end or rest:
            block = file.read(min(BLOCK_BYTES, part.limit - position - len(rest)))
            data = rest + block
            if not data:
                return
            *lines, rest = data.split(b"\n")
            if skipping and lines:
                position += len(lines[0]) + 1
                lines, skipping = lines[1:], False
            offsets = []
            kept = []
            for line in lines:
                if position >= part.end:
                    break
                offsets.append(position)
                kept.append(line)
                position += len(line) + 1
            if kept:
                yield _batch(part, offsets, kept)
            if position >= part.end or not block:
                return


def _batch(part: ByteRange, offsets: list[int], lines: list[bytes]) -> pa.RecordBatch:
    ends = [o + len(x) + 1 for o, x in zip(offsets, lines, strict=True)]
    text = [x.decode("utf-8", "replace") for x in lines]
    return pa.RecordBatch.from_arrays(
        [pa.array([part.entry] * len(text), pa.string()), pa.array([part.path] * len(text)), pa.array(offsets, pa.int64()), pa.array(ends, pa.int64()), pa.array(text)],
        schema=ARROW_SCHEMA,
    )


class LogTail(DataSource):
    """Option ``files``: JSON list of ``{entry, marks: [[path, bookmark, size]]}``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailStreamReader(json.loads(self.options["files"]))


class TailStreamReader(DataSourceStreamReader):
    """Offset: per path, the end of the last whole line and the file's length."""

    def __init__(self, files: list[dict]):
        self.files = files
        self.known = self.initialOffset()

    def initialOffset(self) -> dict:
        return {p: [b, s] for f in self.files for p, b, s in f["marks"]}

    def latestOffset(self) -> dict:
        latest = {}
        for path in sorted({*self.known, *(p for f in self.files for p in expand(f["entry"]))}):
            end, size = self.known.get(path, [0, 0])
            length = file_length(path)
            if length is None:
                latest[path] = [end, size]
                continue
            begin = 0 if length < size else end
            latest[path] = [end_of_last_line(path, begin, length), length]
        return latest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        of = {}
        for f in self.files:
            for path in (*expand(f["entry"]), *(p for p, _, _ in f["marks"])):
                of.setdefault(path, []).append(f["entry"])
        for path, (limit, length) in end.items():
            begin, size = start.get(path, [0, 0])
            for entry in dict.fromkeys(of.get(path, [])):
                parts += byte_ranges(path, 0 if length < size else begin, limit, entry)
        self.known = end
        return parts

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        self.known = end


def tail_files(files: DataFrame, bookmarks: DataFrame) -> str:
    """The ``files`` option of the stream: configured paths, each with the bookmarks of its
    files. A stream's source lists its files on the driver, whatever it is."""
    spark = files.sparkSession
    listed = list_logs(spark, files).select("entry", "path").distinct()
    marks = bookmarks.join(listed, "path").select("entry", "path", "bookmark", "size").collect()
    return json.dumps([
        {"entry": r["path"], "marks": [[m["path"], m["bookmark"], m["size"]] for m in marks if m["entry"] == r["path"]]}
        for r in files.select("path").distinct().collect()
    ])


def ranges_to_read(listing: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """``path, length, first, begin``: where in each file to start, and the ranges of at most
    ``RANGE_BYTES`` from there on. A file that is shorter than it was is read from its start."""
    known = listing.select("path", "length").distinct().join(bookmarks, "path", "left")
    rotated = F.col("length") < F.coalesce("size", F.lit(0))
    first = F.when(rotated, F.lit(0)).otherwise(F.coalesce("bookmark", F.lit(0))).cast("bigint")
    begun = known.select("path", "length", first.alias("first")).filter("first < length")
    steps = F.sequence("first", F.col("length") - 1, F.lit(RANGE_BYTES).cast("bigint"))
    return begun.select("path", "length", "first", F.explode(steps).alias("begin"))


def tail_logs(spark: SparkSession, files: DataFrame, bookmarks: DataFrame, ts: Column) -> DataFrame:
    """Lines behind the bookmarks: ``log_group, group_idx, path, byte_offset, end_offset, seq, ts,
    line``. ``seq`` follows group order, then file order, then names, then position."""
    listing = written(list_logs(spark, files))
    ranges = written(ranges_to_read(listing, bookmarks))
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    step = RANGE_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                end = min(r["begin"] + step, r["length"])
                yield from read_range(ByteRange(r["path"], r["begin"], end, r["length"], r["begin"] == r["first"]))

    raw = ranges.repartition(tasks).mapInArrow(read, SCHEMA).drop("entry")
    return with_group(raw.join(listing.drop("length", "entry"), "path"), ts)


def tail_stream(spark: SparkSession, files: DataFrame, bookmarks: DataFrame, ts: Column) -> DataFrame:
    """As `tail_logs`, as a stream; the query's checkpoint holds the bookmarks. Files that come
    up in a configured folder or fit a glob later are followed too."""
    spark.dataSource.register(LogTail)
    raw = spark.readStream.format("log_tail").option("files", tail_files(files, bookmarks)).load()
    return with_group(raw.join(files.withColumnRenamed("path", "entry"), "entry"), ts)


def with_group(raw: DataFrame, ts: Column) -> DataFrame:
    order = F.struct("group_idx", "file_idx", "path", F.shiftright("byte_offset", 27).alias("range"), "byte_offset")
    return raw.select("log_group", "group_idx", "path", "byte_offset", "end_offset", order.alias("seq"), ts.alias("ts"), "line")
