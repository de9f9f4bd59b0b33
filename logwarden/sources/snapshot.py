"""State snapshots: one folder per version, seen only once complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("state", "bookmarks", "feed", "feed_meta")
MARKER = "version bigint, tables array<string>, batches map<string, bigint>, rows bigint"


def write_state(
    folder: str, version: int, by: dict[str, str] | None = None, batches: dict[str, int] | None = None,
    allowed: Callable[[], None] | None = None, **tables: DataFrame,
) -> None:
    """Write the tables of one version, then the marker that makes it current. Writing
    the same version again gives the same result. ``by``: the column by which a table's files
    are divided; ``batches``: the last batch of each writer that the version holds;
    ``allowed`` is asked right before the marker and may refuse by raising."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        out = table.write.mode("overwrite")
        (out.partitionBy(by[name]) if by and name in by else out).parquet(f"{folder}/version={version}/{name}")
    counted = next((n for n in ("state", "changes") if n in tables), None)
    rows = spark.read.schema(tables[counted].schema).parquet(f"{folder}/version={version}/{counted}").count() if counted else 0
    marker = spark.createDataFrame([(version, sorted(tables), batches or {}, rows)], MARKER)
    if allowed:
        allowed()
    marker.coalesce(1).write.mode("overwrite").parquet(f"{folder}/complete/version_{version}")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Complete versions and the tables in each."""
    return spark.read.schema(MARKER).parquet(f"{folder}/complete/*")


def current_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Highest complete version (below ``before``), None when there is none."""
    try:
        found = versions(spark, folder)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if before is not None:
        found = found.filter(F.col("version") < before)
    return found.agg(F.max("version")).first()[0]


def written_batches(spark: SparkSession, folder: str) -> dict[str, int]:
    """Of each writer the last batch that the current version holds."""
    last = current_version(spark, folder)
    if last is None:
        return {}
    return versions(spark, folder).filter(F.col("version") == last).first()["batches"] or {}


def load_table(spark: SparkSession, folder: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}/{name}")
