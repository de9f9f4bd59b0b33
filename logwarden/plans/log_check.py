"""One check of new log lines: hits, scores, reports, firewall commands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logwarden.operators import feed as feeds
from logwarden.operators import firewall, known, match, report, rules, state
from logwarden.schemas import FEED_COLUMNS, STATE_COLUMNS
from logwarden.settings import Settings
from logwarden.stage import written


@dataclass(frozen=True)
class Config:
    """Rules and settings as they are at one moment."""

    rules: DataFrame
    groups: DataFrame
    settings: Settings
    mask_strings: Column | DataFrame | None = None


@dataclass(frozen=True)
class CheckResult:
    """``changes`` are the state rows that differ afterwards; ``plan`` the commands."""

    changes: DataFrame
    reports: DataFrame
    plan: DataFrame


def check_lines(
    lines: DataFrame, before: DataFrame | Callable[[DataFrame, int], DataFrame], feed: DataFrame, config: Config,
    as_of: int | None = None,
) -> CheckResult:
    """Match lines, fold hits into the state, choose and render reports, and decide on
    rules of changed addresses and of those whose block may have run out. The lines are
    read once; without ``as_of``, decisions are made at the latest time seen in them.
    ``before``: the state, or what looks up the rows of given addresses and of all that are
    due at a time."""
    settings = config.settings
    seen = Observation()
    watched = lines.observe(seen, F.max("ts").alias("latest"))
    hits = written(match.match_rules(watched, config.rules))
    if as_of is None:
        as_of = seen.get["latest"] or 0
    if callable(before):
        before = written(before(hits.select("ip").distinct(), as_of))
    if hits.isEmpty():
        nothing = hits.limit(0).withColumn("categories", F.array().cast("array<int>")).withColumn("comment", F.lit(""))
        return _decided(before, before.limit(0), nothing, feed, config, as_of)
    counted = written(known.known_refused(hits, before, feed))
    folded = written(state.changed_rows(before, counted, settings.multiplier, feed))

    resolved = rules.resolve_report_settings(config.rules, config.groups, settings)
    asked = report.reportable(report.report_settings(counted, resolved), settings)
    emitted = written(report.throttle_reports(asked, folded))
    return _decided(before, written(report.mark_reported(folded, emitted)), emitted, feed, config, as_of)


def _decided(before: DataFrame, scored: DataFrame, emitted: DataFrame, feed: DataFrame, config: Config, as_of: int) -> CheckResult:
    """Rules of the addresses with hits (``scored``) and of those whose block may have run out."""
    settings = config.settings
    ruled = before.filter("has_rule").join(scored.select("ip"), "ip", "left_anti").select(*STATE_COLUMNS)
    looked_at = scored.select(*STATE_COLUMNS, F.lit(True).alias("changed")).unionByName(
        ruled.withColumn("changed", F.lit(False))
    )
    # The state says whether there is a rule; the feed only adds its confidence.
    fed = feed.join(looked_at.select("ip"), "ip", "left_semi").withColumn("has_rule", F.lit(False))
    listed = feed.limit(0).select("ip", "ip_version", F.lit("").alias("line"))
    planned = written(
        firewall.firewall_plan(looked_at.drop("changed"), fed.select(*FEED_COLUMNS), listed, settings, as_of)
    )
    flips = planned.filter("action in ('ADD', 'REMOVE')")
    flipped = flips.select("ip", (F.col("action") == "ADD").alias("rule_after"))
    changes = (
        looked_at.join(flipped, "ip", "left")
        .filter(F.col("changed") | F.col("rule_after").isNotNull())
        .withColumn("has_rule", F.coalesce("rule_after", "has_rule"))
        .select(*STATE_COLUMNS)
    )
    return CheckResult(changes, report.render_reports(emitted, settings, config.mask_strings), flips)


def sync_feed(
    old: DataFrame, new: DataFrame, current: DataFrame, settings: Settings, as_of: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take over a new feed: the feed table with rule flags, the commands, the counts of
    changes. Rules of addresses gone from the feed are looked at again."""
    diff = written(feeds.diff_feed(old, new))
    after = feeds.apply_feed_diff(diff)
    listed = old.filter("has_rule").select("ip", "ip_version", F.lit("").alias("line"))
    gone = feeds.removed_from_feed(diff)
    planned = written(firewall.firewall_plan(current, after, listed, settings, as_of, gone))
    return (
        firewall.apply_plan(after, planned),
        planned.filter("action in ('ADD', 'REMOVE')"),
        feeds.feed_change_counts(diff),
    )
