"""Saved responses of a reputation service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.dates import parse_offset_ts
from logwarden.functions.net import ip_version
from logwarden.functions.text import header_value, parse_headers, parse_uint
from logwarden.schemas import FEED_COLUMNS

# Response layouts.
FEED_RESPONSE = (
    "meta struct<generatedAt: string>, "
    "data array<struct<ipAddress: string, totalReports: bigint, abuseConfidenceScore: string>>"
)
CHECK_RESPONSE = (
    "data struct<ipAddress: string, isPublic: string, ipVersion: int, isWhitelisted: string, "
    "abuseConfidenceScore: int, countryCode: string, countryName: string, totalReports: bigint, "
    "lastReportedAt: string, reports: array<struct<reportedAt: string, comment: string, "
    "categories: array<int>, reporterId: bigint, reporterCountryCode: string, reporterCountryName: string>>>"
)
REPORT_RESPONSE = "data struct<ipAddress: string>, errors array<struct<detail: string>>"
TOO_MANY_REQUESTS = 429


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``body``: one JSON document per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def read_feed(spark: SparkSession, path: str, min_confidence: int = 0) -> DataFrame:
    """Feed rows of saved responses."""
    return parse_feed(read_documents(spark, path), min_confidence)


def parse_feed(documents: DataFrame, min_confidence: int = 0) -> DataFrame:
    """Feed rows out of ``body``; of several entries for one address the first of its
    document counts."""
    parsed = documents.select(F.from_json("body", FEED_RESPONSE).alias("r"))
    entries = parsed.select(F.posexplode("r.data").alias("place", "e"))
    confidence = parse_uint("e.abuseConfidenceScore").cast("int")
    rows = entries.select(
        "place",
        F.col("e.ipAddress").alias("ip"),
        F.col("e.totalReports").alias("total_reports"),
        confidence.alias("confidence"),
    ).filter(F.col("confidence") >= min_confidence)
    first = F.min_by(F.struct("total_reports", "confidence"), F.struct("place", "total_reports", "confidence"))
    return (
        rows.groupBy("ip")
        .agg(first.alias("first"))
        .select("ip", "first.*")
        .withColumn("ip_version", ip_version("ip"))
        .withColumn("has_rule", F.lit(False))
        .select(*FEED_COLUMNS)
    )


def parse_feed_time(documents: DataFrame) -> DataFrame:
    """``gen_time``: when the newest of the feeds was made, in epoch seconds."""
    made = parse_offset_ts(F.from_json("body", FEED_RESPONSE)["meta"]["generatedAt"])
    return documents.agg(F.max(made).alias("gen_time"))


def read_checks(spark: SparkSession, path: str, verbose: bool = False) -> DataFrame:
    return parse_checks(read_documents(spark, path), verbose)


def parse_checks(documents: DataFrame, verbose: bool = False) -> DataFrame:
    """One row per checked address; verbose adds the country name and past reports."""
    parsed = documents.select(F.from_json("body", CHECK_RESPONSE)["data"].alias("d")).filter("d is not null")
    columns = [
        F.col("d.ipAddress").alias("ip"),
        (F.coalesce("d.isPublic", F.lit("")) != "false").alias("is_public"),
        F.col("d.ipVersion").alias("ip_version"),
        (F.coalesce("d.isWhitelisted", F.lit("")) == "true").alias("is_whitelisted"),
        F.col("d.abuseConfidenceScore").alias("confidence"),
        F.col("d.countryCode").alias("country_code"),
        F.col("d.totalReports").alias("total_reports"),
        F.coalesce(local_seconds(F.col("d.lastReportedAt")), F.lit(0)).alias("last_reported_at"),
    ]
    if verbose:
        columns += [
            F.col("d.countryName").alias("country_name"),
            F.transform(
                "d.reports",
                lambda r: F.struct(
                    F.coalesce(local_seconds(r["reportedAt"]), F.lit(0)).alias("reported_at"),
                    r["comment"].alias("comment"),
                    r["categories"].alias("categories"),
                    r["reporterId"].alias("reporter_id"),
                    r["reporterCountryCode"].alias("reporter_country_code"),
                    r["reporterCountryName"].alias("reporter_country_name"),
                ),
            ).alias("reports"),
        ]
    return parsed.select(*columns)


def local_seconds(text: Column) -> Column:
    """Date and time taken as written, whatever offset follows."""
    return parse_offset_ts(F.substring(text, 1, 19))


def check_reports(checks: DataFrame) -> DataFrame:
    """Flat view of verbose checks: one row per past report, addresses without any kept."""
    return checks.select("ip", F.explode_outer("reports").alias("report")).select("ip", "report.*")


def parse_report_responses(responses: DataFrame) -> DataFrame:
    """Outcome of report requests ``status, headers, body``: 'ok', 'rejected' (errors in
    the answer), 'unreadable', 'failed' (other status), with the error texts and, after
    too many requests, the seconds to wait."""
    body = F.from_json("body", REPORT_RESPONSE)
    ok_status = F.col("status") == 200
    outcome = (
        F.when(~ok_status, "failed")
        .when(body["data"].isNotNull(), "ok")
        .when(body["errors"].isNotNull(), "rejected")
        .otherwise("unreadable")
    )
    errors = F.transform(F.coalesce(body["errors"], F.array()), lambda e: e["detail"])
    wait = F.when(
        F.col("status") == TOO_MANY_REQUESTS, parse_uint(header_value(parse_headers("headers"), "retry-after"))
    )
    return responses.withColumn("outcome", outcome).withColumn(
        "errors", F.when(outcome == "ok", F.array().cast("array<string>")).otherwise(errors)
    ).withColumn("retry_after", F.coalesce(wait, F.lit(0)))
