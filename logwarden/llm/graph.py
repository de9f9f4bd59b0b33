"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.stage import written


def _least(edges: DataFrame) -> DataFrame:
    """Every edge with the least neighbour of its first end; that end counts as one."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least.withColumn("least", F.least("a", "least")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), itself included; the root is the
    least node of its component. Null ends are ignored.

    Alternating large-star and small-star steps: each hangs a node's neighbours onto its
    least neighbour until only stars are left, a number of rounds that is logarithmic in
    practice. A step is a grouped minimum (combined before the shuffle) and a join that
    Spark may split at busy nodes. Each round is a table in the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        small = _least(written(large))
        hung = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = written(hung.union(small.select("a", F.col("least").alias("b"))).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
