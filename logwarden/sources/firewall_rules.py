"""Saved firewall listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.firewall import union_rules


def read_firewall_rules(spark: SparkSession, path_v4: str, path_v6: str) -> DataFrame:
    """``ip_version, line`` of both address families."""

    def lines(path: str) -> DataFrame:
        return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))

    return union_rules(lines(path_v4), lines(path_v6))
