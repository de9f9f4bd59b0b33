"""The operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import (
    align, backtrack, bpe, decontaminate, html_text, license_scan, minhash, quality_classifier, quality_rules, token_counts,
    toxicity, url_filter, vector_codes,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.learned(docs, table(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.learned(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.round_trip_digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_html_text": op6_html_text,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_backtrack_bpe": op11_backtrack_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op7_near_duplicates": minhash.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
