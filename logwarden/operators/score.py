"""Decaying score per address.

With multiplier M > 0 every hit adds `score * M` and one point is lost per second;
with M = 0 nothing is lost. The score never exceeds the 32-bit limit.

For one address, in order of time, with running sum C of what was added (a) and time t:

    X = (C - t) - min over earlier rows of (C - a - t)        decay, never below zero
    S = X - max(0, max over earlier rows of (X - limit))      limit

(exact while the rows span less than 136 years). Sums, minima and maxima can be
taken piecewise, so no address is ever handled by one task as a whole:

1. hits are added up per (address, second) with map-side combine; a second without
   decay only adds. For per-hit scores the second is cut further by blocks of `seq`.
2. running values are taken within (address, day),
3. one row per (address, day) carries the totals of earlier days forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.settings import U32_MAX

CHUNK_SECONDS = 86400
SEQ_BLOCK_BITS = 20


def amount(multiplier: int) -> Column:
    """What one hit adds to the score."""
    return F.least(F.col("score") * F.lit(max(multiplier, 1)), F.lit(U32_MAX))


def activity_by_address(hits: DataFrame) -> DataFrame:
    """Counts per kind and time of the last hit of every address."""
    return hits.groupBy("ip").agg(
        _count_of("activity").alias("activity_count"),
        _count_of("refused").alias("refused_count"),
        F.max("ts").alias("last_activity"),
    )


def _count_of(kind: str) -> Column:
    return F.least(F.count(F.when(F.col("kind") == kind, True)), F.lit(U32_MAX))


def per_second(hits: DataFrame, multiplier: int, *more_keys: str) -> DataFrame:
    """Hits added up per address and second: ``added`` and the count of each kind."""
    return (
        hits.withColumn("added", amount(multiplier))
        .groupBy("ip", "ts", *more_keys)
        .agg(
            F.sum("added").alias("added"),
            F.count(F.when(F.col("kind") == "activity", True)).alias("activity"),
            F.count(F.when(F.col("kind") == "refused", True)).alias("refused"),
        )
    )


def running_score(steps: DataFrame, multiplier: int, *order: str) -> DataFrame:
    """Rows ``ip, ts, added`` with ``score_before`` (decayed to the row's time) and
    ``score_after``; ``order`` breaks ties within a second. Adds ``chunk``, the day."""
    local = _within_day(steps, multiplier, *order)
    carried = carry_forward(_day_totals(local)).select("ip", "chunk", "sum_in", "low_in", "over_in")
    in_day = _day_window("ts", *order)
    upto, earlier = in_day.rowsBetween(Window.unboundedPreceding, 0), in_day.rowsBetween(Window.unboundedPreceding, -1)
    low = F.least("low_in", F.col("sum_in") + F.col("low_here"))
    excess = F.col("x") - U32_MAX
    return (
        local.join(carried, ["ip", "chunk"])
        .withColumn("x", F.col("sum_in") + F.col("sum_here") - F.col("clock") - low)
        .withColumn("over_before", F.greatest(F.lit(0), "over_in", F.max(excess).over(earlier)))
        .withColumn("over_after", F.greatest(F.lit(0), "over_in", F.max(excess).over(upto)))
        .select(
            *steps.columns,
            "chunk",
            (F.col("x") - F.col("added") - F.col("over_before")).alias("score_before"),
            (F.col("x") - F.col("over_after")).alias("score_after"),
        )
    )


def final_score(steps: DataFrame, multiplier: int) -> DataFrame:
    """Per address: score after its last row, its time, and the summed counts."""
    carried = carry_forward(_day_totals(_within_day(steps, multiplier)))
    x = F.col("sum_in") + F.col("sum_of") - F.col("clock_of") - F.col("low_upto")
    end = x - F.greatest(F.lit(0), F.col("over_upto"))
    return carried.groupBy("ip").agg(
        F.max("last_of").alias("last_activity"),
        F.max_by(end, F.col("chunk")).alias("score"),
        F.least(F.sum("activity_of"), F.lit(U32_MAX)).alias("activity_count"),
        F.least(F.sum("refused_of"), F.lit(U32_MAX)).alias("refused_count"),
    )


def _day_window(*order: str):
    return Window.partitionBy("ip", "chunk").orderBy(*order)


def _within_day(steps: DataFrame, multiplier: int, *order: str) -> DataFrame:
    """Running values inside each (address, day). The repartitioning is the exchange the
    windows need; it is spelled out so that rows that come in partitioned by address
    alone are spread by day too."""
    upto = _day_window("ts", *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn("chunk", F.floor(F.col("ts") / CHUNK_SECONDS))
        .withColumn("clock", F.col("ts") if multiplier > 0 else F.lit(0).cast("bigint"))
        .repartition("ip", "chunk")
        .withColumn("sum_here", F.sum("added").over(upto))
        .withColumn("low_here", F.min(F.col("sum_here") - F.col("added") - F.col("clock")).over(upto))
    )


def _day_totals(local: DataFrame) -> DataFrame:
    """One row per (address, day) out of the running values within the day. Grouped by
    the keys of the window before it, so it needs no shuffle of its own."""
    return local.groupBy("ip", "chunk").agg(
        F.sum("added").alias("sum_of"),
        F.min("low_here").alias("low_of"),
        F.max(F.col("sum_here") - F.col("clock")).alias("top_of"),
        F.max(F.col("sum_here") - F.col("clock") - F.col("low_here")).alias("rise_of"),
        F.max("clock").alias("clock_of"),
        F.max("ts").alias("last_of"),
        F.sum("activity").alias("activity_of"),
        F.sum("refused").alias("refused_of"),
    )


def carry_forward(totals: DataFrame) -> DataFrame:
    """Add what earlier days hand on: their sum (``sum_in``), minimum (``low_in``) and
    excess over the limit (``over_in``); ``_upto`` includes the day itself."""
    days = Window.partitionBy("ip").orderBy("chunk")
    earlier, upto = days.rowsBetween(Window.unboundedPreceding, -1), days.rowsBetween(Window.unboundedPreceding, 0)
    low = F.col("sum_in") + F.col("low_of")
    highest = F.greatest(F.col("sum_in") + F.col("top_of") - F.col("low_in"), F.col("rise_of"))
    return (
        totals.withColumn("sum_in", F.coalesce(F.sum("sum_of").over(earlier), F.lit(0)))
        .withColumn("low_in", F.min(low).over(earlier))
        .withColumn("low_upto", F.min(low).over(upto))
        .withColumn("highest", highest)
        .withColumn("over_in", F.max(F.col("highest") - U32_MAX).over(earlier))
        .withColumn("over_upto", F.max(F.col("highest") - U32_MAX).over(upto))
    )


def decayed_score(hits: DataFrame, multiplier: int) -> DataFrame:
    """Every hit with ``running_score``, the score of its address right after it.

    Hits are ordered by `(ts, seq)`; ``seq`` is a number, or a struct whose last
    field counts within a bounded block (as from `scan_logs`).
    """
    blocked = hits.withColumn("block", seq_block(hits))
    keys = ["ip", "ts", "block"]
    steps = running_score(per_second(blocked, multiplier, "block"), multiplier, "block")
    upto = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # No point is lost within a second, so hits of one block only add up.
    score = F.col("score_before") + F.sum(amount(multiplier)).over(upto)
    return (
        blocked.join(steps.select(*keys, "score_before"), keys)
        .withColumn("running_score", F.least(score, F.lit(U32_MAX)))
        .select(*hits.columns, "running_score")
    )


def seq_block(hits: DataFrame) -> Column:
    """Monotone block number of ``seq`` with a bounded number of rows per block."""
    kind = hits.schema["seq"].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.col("seq")[f].alias(f) for f in kind.fieldNames()[:-1]])
    return F.shiftright("seq", SEQ_BLOCK_BITS)


def expiry(last_activity="last_activity", score="score") -> Column:
    """Time at which the score of an address has run out."""
    return F.col(last_activity) + F.col(score)
