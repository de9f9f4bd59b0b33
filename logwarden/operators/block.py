"""Block decisions (B1, B2, B4, P9) and the status text.

Expressions work on state columns; ``as_of`` is the time of the decision in epoch
seconds. The feed confidence is NULL for addresses that are not in the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.dates import format_epoch
from logwarden.operators.score import running_score
from logwarden.settings import Settings


def over_threshold(settings: Settings, as_of: int) -> Column:
    """Score, less what has decayed until ``as_of``, is above the block threshold."""
    if settings.multiplier > 0:
        return F.lit(as_of) < F.col("last_activity") + F.col("score") - settings.block_threshold
    return F.col("score") > settings.block_score


def blocked_now(settings: Settings, as_of: int) -> Column:
    """Not on the allow list, and on the deny list or above the threshold."""
    return ~F.col("whitelisted") & (F.col("blacklisted") | over_threshold(settings, as_of))


def should_create_rule(settings: Settings, as_of: int) -> Column:
    """No rule yet and the address is to be blocked. Needs ``confidence``, ``has_rule``."""
    earned = over_threshold(settings, as_of)
    if settings.multiplier > 0:
        in_range = F.col("last_activity") + F.col("score") > settings.block_threshold
        earned = (F.col("score") > 0) & in_range & earned
    in_feed = F.col("confidence") >= settings.feed_block_score
    wanted = (
        F.coalesce("blacklisted", F.lit(False)) | F.coalesce(in_feed, F.lit(False)) | F.coalesce(earned, F.lit(False))
    )
    return ~F.col("has_rule") & ~F.coalesce("whitelisted", F.lit(False)) & wanted


def should_remove_rule(settings: Settings, as_of: int) -> Column:
    """A rule exists and is no longer wanted, or nothing is known about the address.
    Needs ``in_state``, ``in_feed``, ``has_rule``."""
    if settings.multiplier > 0:
        expired = F.lit(as_of) > F.col("last_activity") + F.col("score")
    else:
        expired = F.col("score") == 0
    let_go = F.col("in_state") & ~F.col("blacklisted") & ~F.col("in_feed") & expired
    allowed = F.col("in_state") & F.col("whitelisted")
    return (~F.col("in_state") & ~F.col("in_feed")) | (F.col("has_rule") & F.coalesce(allowed | let_go, F.lit(False)))


def status_label(settings: Settings, as_of: int) -> Column:
    """'whitelisted', 'blacklisted', the time a block ends, 'blocked', or ''."""
    if settings.multiplier > 0:
        blocked = format_epoch(F.col("last_activity") + F.col("score"), settings.date_format)
    else:
        blocked = F.lit("blocked")
    return (
        F.when(F.col("whitelisted"), F.lit("whitelisted"))
        .when(F.col("blacklisted"), F.lit("blacklisted"))
        .when(over_threshold(settings, as_of), blocked)
        .otherwise(F.lit(""))
    )


def block_episodes(steps: DataFrame, settings: Settings) -> DataFrame:
    """``ip, blocked_from, blocked_until``: when a rule would have stood. A block starts
    once the score exceeds the threshold and lasts until the score has run out; it never
    ends without decay. ``steps`` are the hits added up per second (`per_second`).

    Runs of unbroken score are found per (address, day); only the first and last piece
    of a day and pieces with a block go on to be joined across days.
    """
    running = running_score(steps, settings.multiplier)
    over = F.when(F.col("score_after") > settings.block_threshold, F.col("ts"))
    if settings.multiplier == 0:
        started = running.withColumn("over", over).groupBy("ip").agg(F.min("over").alias("blocked_from"))
        return started.filter("blocked_from is not null").withColumn("blocked_until", F.lit(None).cast("bigint"))

    in_day = Window.partitionBy("ip", "chunk").orderBy("ts")
    ends = F.col("ts") + F.col("score_after")
    pieces = (
        running.withColumn("ends", ends)
        .withColumn("breaks", F.coalesce(F.col("ts") > F.lag("ends").over(in_day), F.lit(True)))
        .withColumn("piece", F.sum(F.col("breaks").cast("int")).over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("over", over)
        .groupBy("ip", "chunk", "piece")
        .agg(F.min("ts").alias("starts"), F.min("over").alias("over"), F.max("ends").alias("ends"))
        .withColumn("last_piece", F.max("piece").over(Window.partitionBy("ip", "chunk")))
        .filter("over is not null or piece = 1 or piece = last_piece")
    )
    by_time = Window.partitionBy("ip").orderBy("starts")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    joined = pieces.withColumn(
        "breaks", F.coalesce(F.col("starts") > F.max("ends").over(earlier), F.lit(True))
    ).withColumn("run", F.sum(F.col("breaks").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        joined.groupBy("ip", "run")
        .agg(F.min("over").alias("blocked_from"), F.max("ends").alias("blocked_until"))
        .filter("blocked_from is not null")
        .drop("run")
    )
