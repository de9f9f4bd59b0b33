"""The reputation feed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.net import ip_version
from logwarden.functions.text import clamp_confidence
from logwarden.schemas import FEED_COLUMNS, FEED_META
from logwarden.settings import SYNC_RETRY_SECONDS


def diff_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer comparison by address: ``action`` is new, updated or removed."""
    before = old.select("ip", F.lit(True).alias("in_old"), F.col("ip_version").alias("old_version"), "has_rule")
    after = new.select("ip", F.lit(True).alias("in_new"), "total_reports", "confidence")
    action = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").otherwise("updated")
    )
    return before.join(after, "ip", "full_outer").select(
        "ip",
        action.alias("action"),
        "total_reports",
        "confidence",
        F.coalesce("old_version", ip_version("ip")).alias("ip_version"),
        F.coalesce("has_rule", F.lit(False)).alias("has_rule"),
    )


def feed_change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def apply_feed_diff(diff: DataFrame) -> DataFrame:
    """The feed after a sync: everything but the removed rows; rule flags carry over."""
    return diff.filter(F.col("action") != "removed").select(*FEED_COLUMNS)


def removed_from_feed(diff: DataFrame) -> DataFrame:
    """Addresses whose rule has to be looked at again."""
    return diff.filter(F.col("action") == "removed").select("ip")


def feed_additions(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("ip"), "ip", "left_anti")


def feed_removals(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("ip"), "ip", "left_anti")


def save_feed_records(feed: DataFrame, records: DataFrame) -> DataFrame:
    """Add or replace rows `ip, total_reports, confidence`; one row per address."""
    changed = (
        records.join(feed.select("ip", "has_rule", F.col("ip_version").alias("old_version")), "ip", "left")
        .withColumn("confidence", clamp_confidence("confidence"))
        .withColumn("ip_version", F.coalesce("old_version", ip_version("ip")))
        .withColumn("has_rule", F.coalesce("has_rule", F.lit(False)))
        .select(*FEED_COLUMNS)
    )
    return feed.join(records.select("ip"), "ip", "left_anti").select(*FEED_COLUMNS).unionByName(changed)


def save_feed_meta(spark, sync_time: int, gen_time: int) -> DataFrame:
    """The one row of sync times."""
    return spark.createDataFrame([(sync_time, gen_time)], FEED_META)


def generation_check(old_gen: Column, new_gen: Column) -> Column:
    """'older' and 'same' are worth a warning; 'newer' is how it should be."""
    return F.when(old_gen > new_gen, "older").when(old_gen == new_gen, "same").otherwise("newer")


def feed_generation_check(old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """Compare two one-row tables of sync times."""
    sides = old_meta.select(F.col("gen_time").alias("old_gen"), F.lit(None).cast("bigint").alias("new_gen")).unionByName(
        new_meta.select(F.lit(None).cast("bigint").alias("old_gen"), F.col("gen_time").alias("new_gen"))
    )
    both = sides.agg(F.coalesce(F.max("old_gen"), F.lit(0)).alias("old_gen"), F.max("new_gen").alias("new_gen"))
    return both.withColumn("result", generation_check(F.col("old_gen"), F.col("new_gen")))


def sync_due(interval: int, as_of: int) -> Column:
    """Whether the feed is to be fetched again; an interval of 0 switches it off."""
    return F.lit(interval > 0) & (F.lit(as_of) - F.col("sync_time") >= interval)


def sync_failed(meta: DataFrame) -> DataFrame:
    """Sync times after a failed fetch: try again a little later."""
    return meta.withColumn("sync_time", F.col("sync_time") + SYNC_RETRY_SECONDS)
