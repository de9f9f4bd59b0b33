"""Log files: full scans, bookmarks and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.files import places_of


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, seq, line`` of text files. Lines end at `\\n` only. ``seq`` orders the
    lines of one file: a split of the file is read by one task from front to back, so
    the split's start and a row counter within the task are enough, without a shuffle.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            local_path(F.col("_metadata.file_path")).alias("path"),
            F.struct(
                F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
            ).alias("seq"),
            F.col("value").alias("line"),
        )
    )


def local_path(uri: Column) -> Column:
    """File URI as the plain path it was configured with; other schemes stay."""
    plain = F.regexp_replace(uri, "^file:(//)?(?=/)", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def _configured(files: DataFrame) -> list[str]:
    """Configured paths; the list is as long as the configuration."""
    return [r["path"] for r in files.select("path").distinct().collect()]


def list_logs(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``log_group, group_idx, file_idx, entry, path, length`` of all files that the configured
    paths (``entry``: a file, a folder or a glob) stand for; what is not there is skipped.
    Contents are not read. Names that begin with a dot or an underscore do not count in folders."""
    roots, owners = places_of(spark, _configured(files))
    if not roots:
        return files.limit(0).withColumn("entry", F.col("path")).withColumn("length", F.lit(0).cast("bigint")).select(*LISTED)
    found = spark.read.format("binaryFile").load(roots).select(
        local_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("length")
    ).distinct()
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.substring_index("path", "/", -1)
    table = spark.createDataFrame(owners, "entry string, folder string, names string")
    fits = F.rlike(name, F.concat(F.lit("^(?:"), F.col("names"), F.lit(")$")))
    whose = found.withColumn("folder", folder).join(table, "folder").filter(fits)
    return whose.select("entry", "path", "length").distinct().join(files.withColumnRenamed("path", "entry"), "entry").select(*LISTED)


LISTED = ["log_group", "group_idx", "file_idx", "entry", "path", "length"]


def missing_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Configured paths that stand for no file."""
    return files.join(list_logs(spark, files).select(F.col("entry").alias("path")), "path", "left_anti")


def scan_logs(spark: SparkSession, files: DataFrame, ts: Column) -> DataFrame:
    """All lines of all configured files: ``log_group, group_idx, path, seq, ts, line``. Files are
    ordered by group, then by place in the group, then by name. ``ts`` is the activity time to
    give the lines (epoch seconds): reading time, or parsed from ``line``."""
    roots, _ = places_of(spark, _configured(files))
    found = text_lines(spark, roots) if roots else spark.createDataFrame(
        [], "path string, seq struct<split: bigint, row: bigint>, line string"
    )
    there = list_logs(spark, files)
    order = F.struct("group_idx", "file_idx", "path", F.col("seq.split").alias("split"), F.col("seq.row").alias("row"))
    return found.join(there, "path").select(
        "log_group", "group_idx", "path", order.alias("seq"), ts.alias("ts"), "line"
    )


def detect_rotation(listing: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Bookmarks to start from: back to 0 where a file is now shorter than last time."""
    rotated = F.col("length") < F.col("size")
    return bookmarks.join(listing, "path", "left").select(
        "path",
        F.when(rotated, F.lit(0)).otherwise(F.col("bookmark")).alias("bookmark"),
        "size",
        F.coalesce(rotated, F.lit(False)).alias("rotated"),
    )


def advance_bookmarks(bookmarks: DataFrame, lines: DataFrame, listing: DataFrame) -> DataFrame:
    """Bookmarks after reading: the end of the last whole line of each file, and the
    file's length. ``lines`` has ``path, end_offset``."""
    ends = lines.groupBy("path").agg(F.max("end_offset").alias("end_offset"))
    return (
        bookmarks.join(ends, "path", "left")
        .join(listing, "path", "left")
        .select(
            "path",
            F.coalesce("end_offset", "bookmark").alias("bookmark"),
            F.coalesce("length", "size").alias("size"),
            (F.coalesce("end_offset", "bookmark") != F.col("bookmark")).alias("changed"),
        )
    )


def reconcile_bookmarks(files: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Bookmarks of the configured files: unknown files start at 0, bookmarks of files
    that are no longer configured go."""
    configured = files.select("path").distinct()
    return configured.join(bookmarks, "path", "left").select(
        "path",
        F.coalesce("bookmark", F.lit(0)).alias("bookmark"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )


def dropped_bookmarks(files: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Bookmarks of files that are no longer configured."""
    return bookmarks.join(files.select("path"), "path", "left_anti")
