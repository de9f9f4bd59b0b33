"""Address state of a running monitor: a full table now and then, changes in between.

Version n holds what its batch changed, or everything. A full table's files are divided by a
hash of the address, and beside them lie the addresses with a rule, divided by the hour in
which their score will have run out. So a batch opens the files of the addresses it touches
and of those that are due, however large the state is; what was changed since the full table
is small and is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import schemas
from logwarden.operators.score import expiry
from logwarden.schemas import STATE_COLUMNS
from logwarden.sources.snapshot import current_version, versions, write_state
from logwarden.stage import remove_folder, written

FULL_EVERY = 20
PARTS = 32  # part of the stored form
HOUR = 3600
WHOLE = "part int"
DUE = "ip string, due bigint, hour bigint"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.STATE)


def part_of(ip: str | Column = "ip") -> Column:
    return F.pmod(F.xxhash64(ip), F.lit(PARTS)).cast("int")


def due_at() -> Column:
    """The time from which on a rule may have to go although nothing happens: at once for
    an address on the allow list, never for one on the deny list or without a rule."""
    rule = F.col("has_rule")
    return F.when(rule & F.col("whitelisted"), F.lit(0).cast("bigint")).when(rule & ~F.col("blacklisted"), expiry())


def _history(spark: SparkSession, folder: str, version: int | None) -> tuple[int | None, list[int]]:
    """The last full version and the versions with changes since then."""
    last = current_version(spark, folder, version)
    if last is None:
        return None, []
    done = versions(spark, folder).filter(F.col("version") <= last)
    full = done.filter(F.array_contains("tables", "state")).agg(F.max("version")).first()[0]
    later = done.filter(F.col("version") > (-1 if full is None else full)).select("version").collect()
    return full, sorted(r[0] for r in later)


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATE).parquet(path)


def _base(spark: SparkSession, folder: str, full: int | None) -> DataFrame:
    """The full table with the number of each row's part."""
    if full is None:
        return empty_state(spark).withColumn("part", F.lit(0))
    return spark.read.schema(schemas.STATE.simpleString()[7:-1].replace(":", " ") + f", {WHOLE}").parquet(f"{folder}/version={full}/state")


def _newest(spark: SparkSession, folder: str, later: list[int]) -> DataFrame:
    """The last change of each address; at most ``FULL_EVERY`` batches of them."""
    changes = empty_state(spark).withColumn("version", F.lit(0).cast("bigint"))
    for version in later:
        changes = changes.unionByName(_load(spark, f"{folder}/version={version}/changes").withColumn("version", F.lit(version).cast("bigint")))
    return changes.groupBy("ip").agg(F.max_by(F.struct(*STATE_COLUMNS), "version").alias("row")).select("row.*")


def state_before(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The state as batch ``version`` finds it; without a version, as it is now."""
    full, later = _history(spark, folder, version)
    base = _base(spark, folder, full).select(*STATE_COLUMNS)
    if not later:
        return base
    newest = _newest(spark, folder, later)
    return base.join(newest.select("ip"), "ip", "left_anti").select(*STATE_COLUMNS).unionByName(newest)


def state_of(spark: SparkSession, folder: str, ips: DataFrame, as_of: int, version: int | None = None) -> DataFrame:
    """The rows that matter to a batch: those of the addresses ``ips``, and those whose rule
    may have to go by ``as_of``. Only their files of the full table are opened."""
    full, later = _history(spark, folder, version)
    newest = written(_newest(spark, folder, later)) if later else empty_state(spark)
    wanted = ips.select("ip").unionByName(newest.filter(due_at() < as_of).select("ip"))
    if full is not None:
        due = spark.read.schema(DUE).parquet(f"{folder}/version={full}/due")
        wanted = wanted.unionByName(due.filter((F.col("hour") <= as_of // HOUR) & (F.col("due") < as_of)).select("ip"))
    wanted = written(wanted.distinct())
    parts = [r[0] for r in wanted.select(part_of().alias("part")).distinct().collect()]  # PARTS at most
    base = _base(spark, folder, full).filter(F.col("part").isin(parts)) if parts else empty_state(spark)
    base = base.join(wanted, "ip", "left_semi").join(newest.select("ip"), "ip", "left_anti")
    return base.select(*STATE_COLUMNS).unionByName(newest.join(wanted, "ip", "left_semi").select(*STATE_COLUMNS))


def write_changes(
    spark: SparkSession, folder: str, version: int, changes: DataFrame,
    batches: dict[str, int] | None = None, allowed: Callable[[], None] | None = None,
) -> None:
    """Write what a batch changed; or the whole state when there are ``FULL_EVERY`` versions
    since it was last written whole, or as many changed rows as half of it. Then versions
    before the last but one whole state go: only the newest batch can run again, and it reads
    nothing older."""
    done = []
    if current_version(spark, folder, version) is not None:
        done = sorted((r["version"], "state" in r["tables"], r["rows"] or 0) for r in versions(spark, folder).filter(F.col("version") < version).collect())
    whole = [(v, rows) for v, full, rows in done if full]
    since = [rows for v, _, rows in done if not whole or v > whole[-1][0]]
    pending = sum(since) + changes.count()
    if len(since) + 1 < FULL_EVERY and (not pending or whole and 2 * pending < whole[-1][1]):
        write_state(folder, version, None, batches, allowed, changes=changes)
        return
    kept = state_before(spark, folder, version).join(changes.select("ip"), "ip", "left_anti").select(*STATE_COLUMNS)
    rows = written(kept.unionByName(changes))
    due = rows.select("ip", due_at().alias("due")).filter("due IS NOT NULL").withColumn("hour", F.floor(F.col("due") / HOUR))
    write_state(
        folder, version, {"state": "part", "due": "hour"}, batches, allowed,
        state=rows.withColumn("part", part_of()).hint("rebalance", "part"), due=due.hint("rebalance", "hour"),
    )
    for old in (v for v, _, _ in done if whole and v < whole[-1][0]):
        remove_folder(spark, f"{folder}/complete/version_{old}")
        remove_folder(spark, f"{folder}/version={old}")
