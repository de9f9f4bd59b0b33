"""Hits joined with what is known about their address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators.skew import salted_join
from logwarden.stage import written


def attach_state(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Hits with the state columns of their address, NULL where there is none."""
    counts = hits.groupBy("ip").agg(F.count("*").alias("n"))
    return salted_join(hits, state.drop("score", "ip_version"), "ip", counts)


def known_refused(hits: DataFrame, state: DataFrame | None = None, feed: DataFrame | None = None) -> DataFrame:
    """Drop refused hits of addresses nothing is known about: not in the state, not in
    the feed, and without an activity hit at the same or an earlier position."""
    return _with_knowledge(hits, state, feed).filter("known").select(*hits.columns)


def unknown_refused(hits: DataFrame, state: DataFrame | None = None, feed: DataFrame | None = None) -> DataFrame:
    """The refused hits that `known_refused` drops."""
    return _with_knowledge(hits, state, feed).filter("not known").select(*hits.columns)


def _with_knowledge(hits: DataFrame, state: DataFrame | None, feed: DataFrame | None) -> DataFrame:
    at = F.struct("ts", "seq")
    seen = written(hits.groupBy("ip").agg(
        F.count(F.when(F.col("kind") == "refused", True)).alias("n"),
        F.min(F.when(F.col("kind") == "activity", at)).alias("first_activity"),
    ))
    known = seen.select("ip", "first_activity", F.lit(False).alias("listed"))
    asked = seen.filter("n > 0").select("ip")  # nothing else of the state and the feed is moved
    for listed in (state, feed):
        if listed is not None:
            known = known.unionByName(
                listed.join(asked, "ip", "left_semi").select("ip", F.lit(None).cast(seen.schema["first_activity"].dataType).alias("first_activity"),
                              F.lit(True).alias("listed"))
            )
    known = known.groupBy("ip").agg(
        F.min("first_activity").alias("first_activity"), F.max("listed").alias("listed")
    )
    # Activity hits pass unjoined; only refused ones need the lookup.
    refused = salted_join(hits.filter(F.col("kind") == "refused"), known, "ip", seen.select("ip", "n"))
    is_known = F.coalesce(F.col("listed") | (F.col("first_activity") <= at), F.col("listed"), F.lit(False))
    judged = refused.withColumn("known", is_known).select(*hits.columns, "known")
    return hits.filter(F.col("kind") == "activity").withColumn("known", F.lit(True)).unionByName(judged)
