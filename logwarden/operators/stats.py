"""Summaries, top lists and listings of the state (A2, O1-O3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators.block import blocked_now, over_threshold, status_label
from logwarden.settings import Settings

TOP = 5
TOP_COLUMNS = ["ip", "activity_count", "score", "refused_count", "last_activity", "status"]


def summary(state: DataFrame, feed: DataFrame, meta: DataFrame, settings: Settings, as_of: int) -> DataFrame:
    """One row of totals. Each table is added up on its own; the three rows are then
    laid over each other."""
    denied = ~F.col("whitelisted") & F.col("blacklisted")
    blocked = ~F.col("whitelisted") & (F.col("blacklisted") | over_threshold(settings, as_of))
    of_state = state.agg(
        F.count("*").alias("addresses"),
        F.coalesce(F.sum("activity_count"), F.lit(0)).alias("total_activity"),
        F.coalesce(F.sum("refused_count"), F.lit(0)).alias("total_refused"),
        F.count(F.when(F.col("whitelisted"), True)).alias("total_whitelisted"),
        F.count(F.when(denied, True)).alias("total_blacklisted"),
        F.count(F.when(blocked, True)).alias("total_blocked"),
    )
    of_feed = feed.agg(F.count("*").alias("feed_size"))
    of_meta = meta.agg(F.max("sync_time").alias("sync_time"), F.max("gen_time").alias("gen_time"))
    rows = of_state.unionByName(of_feed, True).unionByName(of_meta, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def top_active(state: DataFrame, settings: Settings, as_of: int, n: int = TOP) -> DataFrame:
    """Addresses with the most hits of both kinds."""
    most = (F.col("activity_count") + F.col("refused_count")).desc()
    top = state.orderBy(most, "ip").limit(n)
    return top.withColumn("status", status_label(settings, as_of)).select(*TOP_COLUMNS)


def last_active(state: DataFrame, settings: Settings, as_of: int, n: int = TOP) -> DataFrame:
    """Addresses seen last."""
    top = state.orderBy(F.col("last_activity").desc(), "ip").limit(n)
    return top.withColumn("status", status_label(settings, as_of)).select(*TOP_COLUMNS)


def list_addresses(
    state: DataFrame,
    settings: Settings,
    as_of: int,
    every: bool = False,
    count: bool = False,
    time: bool = False,
) -> DataFrame:
    """Blocked (or all) addresses in order of their text."""
    columns = ["ip"]
    columns += ["activity_count", "score", "refused_count"] if count else []
    columns += ["last_activity"] if time else []
    chosen = state if every else state.filter(blocked_now(settings, as_of))
    return chosen.select(*columns).orderBy("ip")
