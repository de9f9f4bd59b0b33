"""Sectioned rule configuration.

A `[Global]` section holds settings, each `[Log.<name>]` section one log group: its
files and rules. An attribute line belongs to the rule before it. All files given are
read by one job; the lines of each file are put in order on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.functions.text import (
    clamp_feed_score,
    parse_categories,
    parse_tristate,
    parse_uint,
    trim_left,
    trim_right,
)
from logwarden.settings import Settings
from logwarden.sources.logs import text_lines

# The names of settings in a config file.
GLOBAL_KEYS = {
    "log.level": "log_level",
    "log.check.interval": "check_interval",
    "address.block.score": "block_score",
    "address.block.multiplier": "multiplier",
    "iptables.rules.block": "rule_template",
    "iptables.rules.pos": "rule_position",
    "datetime.format": "date_format",
    "datafile.path": "state_path",
    "abuseipdb.api.url": "api_url",
    "abuseipdb.api.key": "api_key",
    "abuseipdb.datetime.format": "api_date_format",
    "abuseipdb.blacklist.interval": "feed_interval",
    "abuseipdb.block.score": "feed_block_score",
    "abuseipdb.report.all": "report_all",
    "abuseipdb.report.mask": "report_mask",
    "abuseipdb.report.categories": "categories",
    "abuseipdb.report.comment": "comment",
}
GROUP_KEYS = {
    "abuseipdb.report.all": "group_report",
    "abuseipdb.report.categories": "group_categories",
    "abuseipdb.report.comment": "group_comment",
    "log.path": "path",
    "log.pattern": "activity",
    "log.score": "score",
    "log.refused.pattern": "refused",
    "log.refused.score": "score",
    "log.abuseipdb.report": "report",
    "log.abuseipdb.categories": "categories",
    "log.abuseipdb.comment": "comment",
}
GLOBAL_SECTION = "[Global"
GROUP_SECTION = "[Log."


def read_config(spark: SparkSession, *paths: str) -> DataFrame:
    """``config, seq, line`` of config files."""
    return text_lines(spark, list(paths)).select(F.col("path").alias("config"), "seq", "line")


def config_entries(lines: DataFrame) -> DataFrame:
    """Meaningful lines as ``config, seq, group_no, log_group, rule_no, key, value``.
    Group 0 is the global section; ``rule_no`` counts accepted patterns in the group."""
    text = trim_right(trim_left("line"))
    cut = F.when(F.contains(text, F.lit("#")), trim_right(F.substring_index(text, "#", 1))).otherwise(text)
    clean = lines.filter(~F.startswith(text, F.lit("#"))).select("config", "seq", cut.alias("text"))

    bracketed = F.col("text").rlike(r"\[\S+\]")
    is_group = bracketed & (F.substring("text", 2, 4) == "Log.")
    is_global = bracketed & (F.substring("text", 2, 6) == "Global")
    in_file = Window.partitionBy("config").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    headed = clean.withColumn("is_group", is_group).withColumn("is_global", is_global)
    groups_so_far = F.sum(F.col("is_group").cast("int")).over(in_file)
    in_section = F.last(
        F.when(F.col("is_group"), F.lit(True)).when(F.col("is_global"), F.lit(False)), ignorenulls=True
    ).over(in_file)
    name = F.substring("text", F.lit(6), F.length("text") - 6)
    placed = (
        headed.withColumn("group_no", F.when(F.coalesce(in_section, F.lit(False)), groups_so_far).otherwise(0))
        .withColumn("log_group", F.last(F.when(F.col("is_group"), name), ignorenulls=True).over(in_file))
        .withColumn("log_group", F.when(F.col("group_no") > 0, F.col("log_group")))
    )

    value = F.substring("text", F.locate("=", F.col("text")) + 1, F.length("text"))
    keyed = (
        placed.withColumn(
            "key",
            F.when(F.col("is_group"), "section")
            .when(F.col("group_no") == 0, _key_of(GLOBAL_KEYS))
            .otherwise(_key_of(GROUP_KEYS)),
        )
        .withColumn("value", trim_left(F.when(F.contains("text", F.lit("=")), value)))
        .filter("key = 'section' or (key is not null and value is not null)")
    )
    accepted = F.col("key").isin("activity", "refused") & F.contains("value", F.lit("%i"))
    return (
        keyed.withColumn("accepted", accepted)
        .withColumn("rule_no", F.sum(accepted.cast("int")).over(
            Window.partitionBy("config", "group_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
        .select("config", "seq", "group_no", "log_group", "rule_no", "key", "value", "accepted")
    )


def _key_of(names: dict[str, str]) -> Column:
    """Meaning of the line by how it begins; longer names are tried first."""
    meaning = F.lit(None).cast("string")
    for name in sorted(names, key=len):
        meaning = F.when(F.startswith("text", F.lit(name)), F.lit(names[name])).otherwise(meaning)
    return meaning


def _last(key: str) -> Column:
    return F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("seq")))


def _all_categories(key: str) -> Column:
    """Categories of all lines with this key, one after the other."""
    parts = F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("seq", "value"))))
    return F.flatten(F.transform(parts, lambda p: parse_categories(p["value"])))


def load_rules(entries: DataFrame) -> DataFrame:
    """Rules of all groups, in order; columns as in `schemas.RULES` plus ``config``."""
    of_rule = entries.filter("group_no > 0 and rule_no > 0 and (accepted or key not in ('activity', 'refused'))")
    rules = of_rule.groupBy("config", "group_no", "rule_no").agg(
        F.max("log_group").alias("log_group"),
        F.max(F.when(F.col("accepted"), F.col("key"))).alias("kind"),
        F.max(F.when(F.col("accepted"), F.col("value"))).alias("pattern"),
        F.coalesce(parse_uint(_last("score")), F.lit(1)).alias("parsed_score"),
        F.max(F.col("key") == "score").alias("has_score"),
        parse_tristate(_last("report")).alias("report"),
        _all_categories("categories").alias("categories"),
        _last("comment").alias("comment"),
    )
    in_kind = Window.partitionBy("config", "group_no", "kind").orderBy("rule_no")
    return rules.select(
        "config",
        "log_group",
        (F.col("group_no") - 1).cast("int").alias("group_idx"),
        "kind",
        (F.row_number().over(in_kind) - 1).alias("rule_idx"),
        "pattern",
        F.when(F.col("has_score"), F.col("parsed_score")).otherwise(1).alias("score"),
        "report",
        "categories",
        "comment",
    )


def rejected_patterns(entries: DataFrame) -> DataFrame:
    """Patterns without address placeholder; they are left out."""
    return entries.filter("group_no > 0 and key in ('activity', 'refused') and not accepted").select(
        "config", "log_group", F.col("key").alias("kind"), F.col("value").alias("pattern")
    )


def load_groups(entries: DataFrame) -> DataFrame:
    """Log groups with their report settings; columns as in `schemas.GROUPS`."""
    return (
        entries.filter("group_no > 0")
        .groupBy("config", "group_no")
        .agg(
            F.max("log_group").alias("log_group"),
            parse_tristate(_last("group_report")).alias("report"),
            _all_categories("group_categories").alias("categories"),
            _last("group_comment").alias("comment"),
        )
        .select(
            "config", "log_group", (F.col("group_no") - 1).cast("int").alias("group_idx"),
            "report", "categories", "comment",
        )
    )


def load_files(entries: DataFrame) -> DataFrame:
    """Log files of every group in order; columns as in `schemas.FILES`."""
    in_group = Window.partitionBy("config", "group_no").orderBy("seq")
    return entries.filter("group_no > 0 and key = 'path'").select(
        "config",
        "log_group",
        (F.col("group_no") - 1).cast("int").alias("group_idx"),
        (F.row_number().over(in_group) - 1).alias("file_idx"),
        F.col("value").alias("path"),
    )


def load_globals(entries: DataFrame) -> DataFrame:
    """Global settings, one row per config, defaults filled in."""
    default = Settings()

    def number(key: str, otherwise: int) -> Column:
        return F.coalesce(F.when(_last(key).isNotNull(), parse_uint(_last(key))), F.lit(otherwise))

    def is_true(key: str, otherwise: bool) -> Column:
        return F.coalesce(F.lower(_last(key)) == "true", F.lit(otherwise))

    last_categories = parse_categories(F.max_by(
        F.when((F.col("key") == "categories"), F.col("value")),
        F.when((F.col("key") == "categories"), F.col("seq")),
    ))
    template = F.max_by(
        F.when((F.col("key") == "rule_template") & F.contains("value", F.lit("%i")), F.col("value")),
        F.when((F.col("key") == "rule_template") & F.contains("value", F.lit("%i")), F.col("seq")),
    )
    defaults = F.array(*[F.lit(c) for c in default.default_categories]).cast("array<int>")
    return (
        entries.withColumn("key", F.when(F.col("group_no") == 0, F.col("key")).otherwise("of_group"))
        .groupBy("config")
        .agg(
            number("block_score", default.block_score).alias("block_score"),
            number("multiplier", default.multiplier).alias("multiplier"),
            clamp_feed_score(number("feed_block_score", default.feed_block_score)).alias("feed_block_score"),
            is_true("report_all", False).alias("report_all"),
            is_true("report_mask", True).alias("report_mask"),
            F.when(F.max(F.col("key") == "categories"), last_categories).otherwise(defaults).alias("default_categories"),
            _last("comment").alias("default_comment"),
            (F.length(F.coalesce(_last("api_key"), F.lit(""))) > 0).alias("reporting_enabled"),
            F.coalesce(_last("date_format"), F.lit(default.date_format)).alias("date_format"),
            F.coalesce(template, F.lit(default.rule_template)).alias("rule_template"),
            F.coalesce(F.lower(_last("rule_position")) == "tail", F.lit(False)).alias("append_rules"),
            number("check_interval", default.check_interval).alias("check_interval"),
            number("feed_interval", default.feed_interval).alias("feed_interval"),
        )
    )


def load_settings(entries: DataFrame) -> Settings:
    """Global settings of a single config file."""
    row = load_globals(entries).drop("config").first()
    if row is None:
        return Settings()
    values = row.asDict()
    values["default_categories"] = tuple(values["default_categories"])
    return Settings(**values)
