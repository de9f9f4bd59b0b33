"""From documents to encoded training text: each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir); its result is written and read again as the next one's
docs. Models are fitted on the labelled rows of the whole ``documents`` table, so that the
rules see examples of what the classifier before them has already rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import bpe, decontaminate, minhash, quality_classifier, quality_rules
from logwarden.stage import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.learned(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_classifier.passing(docs, model)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees over their statistics."""
    forest = quality_rules.learned(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_rules.passing(docs, forest)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, by document."""
    return bpe.round_trip_digests(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("near-duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("byte-pair encoding", encoded),
]

# Fitted models and byte-pair merges have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
