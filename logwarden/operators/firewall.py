"""Firewall rule listings and plans (P8, J5-J7, B3, B5, S19). Nothing is executed:
the result is a table of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.net import IP_PATTERN, ip_version
from logwarden.operators.block import should_create_rule, should_remove_rule
from logwarden.settings import Settings

PLACEHOLDER = "%i"
CHAIN = "INPUT"


def template_parts(template: str) -> tuple[str, str]:
    """Text before and after the address placeholder."""
    head, found, tail = template.partition(PLACEHOLDER)
    return (head, tail) if found else ("", "")


def parse_rules(listing: DataFrame, template: str) -> DataFrame:
    """``ip, ip_version, line`` of the listed rules that look like the template; the
    address is the first one in the line."""
    head, tail = template_parts(template)
    like_template = F.contains("line", F.lit(head)) & F.contains("line", F.lit(tail))
    address = F.regexp_extract("line", IP_PATTERN, 0)
    return (
        listing.filter(like_template)
        .select(address.alias("ip"), "ip_version", "line")
        .filter(F.col("ip") != "")
    )


def union_rules(v4: DataFrame, v6: DataFrame) -> DataFrame:
    """Both listings as one, with the address family of each."""
    return v4.select(F.lit(4).alias("ip_version"), "line").unionByName(
        v6.select(F.lit(6).alias("ip_version"), "line")
    )


def unknown_rules(parsed: DataFrame, state: DataFrame, feed: DataFrame) -> DataFrame:
    """Rules of addresses that neither the state nor the feed knows."""
    return parsed.join(state.select("ip"), "ip", "left_anti").join(feed.select("ip"), "ip", "left_anti")


def sync_rule_flag(state: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rule known to one of the tables is known to both."""
    return _share_flag(state, feed), _share_flag(feed, state)


def _share_flag(table: DataFrame, other: DataFrame) -> DataFrame:
    theirs = other.filter("has_rule").select("ip", F.lit(True).alias("other_has_rule"))
    flag = F.col("has_rule") | F.coalesce("other_has_rule", F.lit(False))
    return table.join(theirs, "ip", "left").withColumn("has_rule", flag).select(*table.columns)


def reconcile_firewall(parsed: DataFrame, state: DataFrame, feed: DataFrame) -> DataFrame:
    """One row per address known anywhere, with its state, its feed confidence and
    whether it has a rule."""
    ruled = parsed.groupBy("ip").agg(F.lit(True).alias("listed"))
    known = state.select("*", F.lit(True).alias("in_state")).withColumnRenamed("has_rule", "state_has_rule")
    fed = feed.select(
        "ip", "confidence", F.col("ip_version").alias("feed_version"), F.col("has_rule").alias("feed_has_rule"),
        F.lit(True).alias("in_feed"),
    )
    flags = ("listed", "state_has_rule", "feed_has_rule")
    has_rule = F.lit(False)
    for flag in flags:
        has_rule = has_rule | F.coalesce(flag, F.lit(False))
    return (
        known.join(fed, "ip", "full_outer")
        .join(ruled, "ip", "full_outer")
        .withColumn("has_rule", has_rule)
        .withColumn("in_state", F.coalesce("in_state", F.lit(False)))
        .withColumn("in_feed", F.coalesce("in_feed", F.lit(False)))
        .withColumn("ip_version", F.coalesce("ip_version", "feed_version", ip_version("ip")))
        .drop(*flags, "feed_version")
    )


def firewall_plan(
    state: DataFrame,
    feed: DataFrame,
    parsed: DataFrame,
    settings: Settings,
    as_of: int,
    dropped: DataFrame | None = None,
) -> DataFrame:
    """``ip, ip_version, action, command`` for every address with a rule or in need of
    one. Rules of unknown addresses are reported, not touched; addresses in ``dropped``
    (just removed from state or feed) that are in neither table any more are removed,
    whether or not a rule is listed."""
    known = reconcile_firewall(parsed, state, feed)
    if dropped is None:
        gone = F.lit(False)
    else:
        marks = dropped.select("ip").distinct().withColumn("gone", F.lit(True))
        known = known.join(marks, "ip", "full_outer").withColumn("ip_version", F.coalesce("ip_version", ip_version("ip")))
        for flag in ("in_state", "in_feed", "has_rule"):
            known = known.withColumn(flag, F.coalesce(flag, F.lit(False)))
        gone = F.coalesce("gone", F.lit(False))
    nowhere = ~F.col("in_state") & ~F.col("in_feed")
    action = (
        F.when(nowhere & ~gone, "UNKNOWN")
        .when(should_remove_rule(settings, as_of), "REMOVE")
        .when(should_create_rule(settings, as_of), "ADD")
        .when(F.col("has_rule"), "KEEP")
    )
    planned = known.select("ip", "ip_version", action.alias("action")).filter("action is not null")
    return planned.withColumn("command", firewall_command(settings))


def firewall_command(settings: Settings) -> Column:
    """Command text for rows `ip, ip_version, action`; NULL when there is nothing to do."""
    head, tail = template_parts(settings.rule_template)
    tool = F.when(F.col("ip_version") == 6, F.lit("ip6tables")).otherwise(F.lit("iptables"))
    rule = F.concat(F.lit(head), F.col("ip"), F.lit(tail))
    add = f" -A {CHAIN} " if settings.append_rules else f" -I {CHAIN} 1 "
    return F.when(F.col("action") == "ADD", F.concat(tool, F.lit(add), rule)).when(
        F.col("action") == "REMOVE", F.concat(tool, F.lit(f" -D {CHAIN} "), rule)
    )


def apply_plan(table: DataFrame, plan: DataFrame) -> DataFrame:
    """State or feed with ``has_rule`` as it is after the plan was carried out."""
    after = plan.filter(F.col("action").isin("ADD", "KEEP", "REMOVE")).select(
        "ip", (F.col("action") != "REMOVE").alias("rule_after")
    )
    flag = F.coalesce("rule_after", F.lit(False))
    return table.join(after, "ip", "left").withColumn("has_rule", flag).select(*table.columns)


def migrate_rule_template(listing: DataFrame, old: Settings, new: Settings) -> DataFrame:
    """After a change of template: remove each rule of the old form, add the new one."""
    steps = F.explode(F.array(F.lit("REMOVE"), F.lit("ADD"))).alias("action")
    command = F.when(F.col("action") == "REMOVE", firewall_command(old)).otherwise(firewall_command(new))
    return (
        parse_rules(listing, old.rule_template)
        .select("ip", "ip_version", steps)
        .withColumn("command", command)
    )


def removal_plan(ips: DataFrame, parsed: DataFrame, settings: Settings) -> DataFrame:
    """Commands that drop the rules of addresses removed by hand."""
    ruled = parsed.join(ips.select("ip").distinct(), "ip", "left_semi")
    return ruled.select("ip", "ip_version", F.lit("REMOVE").alias("action")).withColumn(
        "command", firewall_command(settings)
    )
