"""Joining a large table on a key that may hold most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than an even share of one shuffle partition, and into how
    many pieces to cut them. ``counts`` has the key and ``n``. With P partitions there
    can be no more than P such keys and 2P pieces, so the result is safe to broadcast."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.select(F.sum("n")).scalar()
    pieces = F.ceil(F.col("n") * partitions / total).cast("int")
    return counts.filter(F.col("n") * partitions > total).select(key, pieces.alias("pieces"))


def salted_join(facts: DataFrame, dim: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """Join ``facts`` with the unique rows of ``dim``; hot keys are cut into pieces on
    the fact side and repeated once per piece on the other."""
    hot = F.broadcast(hot_keys(counts, key))
    salt = F.pmod(F.xxhash64(*facts.columns), F.coalesce("pieces", F.lit(1)))
    salted = facts.join(hot, key, "left").withColumn("salt", salt.cast("int")).drop("pieces")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    repeated = dim.join(hot, key, "left").withColumn("salt", copies).drop("pieces")
    return salted.join(repeated, [key, "salt"], how).drop("salt")
