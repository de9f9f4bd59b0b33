"""Canonical schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORIES = T.ArrayType(T.IntegerType())

RULES = T.StructType([
    T.StructField("log_group", T.StringType()),
    T.StructField("group_idx", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("rule_idx", T.IntegerType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("report", T.BooleanType()),
    T.StructField("categories", CATEGORIES),
    T.StructField("comment", T.StringType()),
])

GROUPS = T.StructType([
    T.StructField("log_group", T.StringType()),
    T.StructField("group_idx", T.IntegerType()),
    T.StructField("report", T.BooleanType()),
    T.StructField("categories", CATEGORIES),
    T.StructField("comment", T.StringType()),
])

FILES = T.StructType([
    T.StructField("log_group", T.StringType()),
    T.StructField("group_idx", T.IntegerType()),
    T.StructField("file_idx", T.IntegerType()),
    T.StructField("path", T.StringType()),
])

STATE = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("last_activity", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("activity_count", T.LongType()),
    T.StructField("refused_count", T.LongType()),
    T.StructField("whitelisted", T.BooleanType()),
    T.StructField("blacklisted", T.BooleanType()),
    T.StructField("last_reported", T.LongType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("has_rule", T.BooleanType()),
])

FEED = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("total_reports", T.LongType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("has_rule", T.BooleanType()),
])

FEED_META = T.StructType([
    T.StructField("sync_time", T.LongType()),
    T.StructField("gen_time", T.LongType()),
])

BOOKMARKS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bookmark", T.LongType()),
    T.StructField("size", T.LongType()),
])

REPORTS = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("categories", CATEGORIES),
    T.StructField("comment", T.StringType()),
])

STATE_COLUMNS = STATE.fieldNames()
FEED_COLUMNS = FEED.fieldNames()
