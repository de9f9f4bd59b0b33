"""The keyed state table: one row per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.net import ip_version
from logwarden.operators.score import final_score, per_second
from logwarden.operators.skew import salted_join
from logwarden.schemas import STATE, STATE_COLUMNS
from logwarden.stage import written


def new_address(ip: Column, last_activity: Column) -> list[Column]:
    """Columns of a state row without any history."""
    values = {
        "ip": ip,
        "last_activity": last_activity,
        "score": F.lit(0),
        "activity_count": F.lit(0),
        "refused_count": F.lit(0),
        "whitelisted": F.lit(False),
        "blacklisted": F.lit(False),
        "last_reported": F.lit(0),
        "ip_version": ip_version(ip),
        "has_rule": F.lit(False),
    }
    return [values[f.name].cast(f.dataType).alias(f.name) for f in STATE.fields]


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the rows whose address is in ``changes`` and add the new ones. ``changes``
    is read twice, so hand in a written table when it is costly."""
    return state.join(changes.select("ip"), "ip", "left_anti").select(*STATE_COLUMNS).unionByName(
        changes.select(*STATE_COLUMNS)
    )


def changed_rows(state: DataFrame, hits: DataFrame, multiplier: int, feed: DataFrame | None = None) -> DataFrame:
    """State rows of all addresses with hits. A hit older than the address's last
    activity counts as happening at it. A new address that the feed already gave a
    rule starts out with it."""
    steps = written(per_second(hits, multiplier))
    before = written(state.join(steps.select("ip").distinct(), "ip", "left_semi"))
    in_time = steps if before.isEmpty() else _not_before_known(steps, before)
    seed = before.select(
        "ip",
        F.col("last_activity").alias("ts"),
        F.col("score").alias("added"),
        F.col("activity_count").alias("activity"),
        F.col("refused_count").alias("refused"),
    )
    scored = final_score(in_time.unionByName(seed), multiplier)
    kept = before.select("ip", "whitelisted", "blacklisted", "last_reported", "ip_version", "has_rule")
    if feed is None:
        fed = F.lit(False)
    else:
        scored = scored.join(feed.select("ip", F.col("has_rule").alias("fed_rule")), "ip", "left")
        fed = F.coalesce("fed_rule", F.lit(False))
    return scored.join(kept, "ip", "left").select(
        "ip",
        "last_activity",
        "score",
        "activity_count",
        "refused_count",
        F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"),
        F.coalesce("blacklisted", F.lit(False)).alias("blacklisted"),
        F.coalesce("last_reported", F.lit(0).cast("bigint")).alias("last_reported"),
        F.coalesce("ip_version", ip_version("ip")).alias("ip_version"),
        F.coalesce("has_rule", fed).alias("has_rule"),
    )


def _not_before_known(steps: DataFrame, before: DataFrame) -> DataFrame:
    """Hits per second, none earlier than the last activity of its address. A busy address is
    looked up in pieces, and what falls on one second is one row again."""
    known_since = before.select("ip", F.col("last_activity").alias("known_at"))
    counts = steps.groupBy("ip").agg(F.count("*").alias("n"))
    late = F.greatest("ts", F.coalesce("known_at", "ts"))
    return (
        salted_join(steps, known_since, "ip", counts).withColumn("ts", late)
        .groupBy("ip", "ts").agg(*[F.sum(c).alias(c) for c in ("added", "activity", "refused")])
    )


def update_state(state: DataFrame, hits: DataFrame, multiplier: int) -> DataFrame:
    """Fold hits into the state: decayed score, counts, time of last activity."""
    return upsert_state(state, written(changed_rows(state, hits, multiplier)))


def state_from_hits(hits: DataFrame, multiplier: int) -> DataFrame:
    """State after hits on an empty table; as `update_state`, without the joins."""
    scored = final_score(per_second(hits, multiplier), multiplier)
    blank = {c.name: v for c, v in zip(STATE.fields, new_address(F.col("ip"), F.lit(0)), strict=True)}
    return scored.select(*[c if c in scored.columns else blank[c] for c in STATE_COLUMNS])


def remove_addresses(state: DataFrame, ips: DataFrame) -> DataFrame:
    """State without the given addresses."""
    return state.join(ips.select("ip"), "ip", "left_anti").select(*state.columns)


def unknown_removals(state: DataFrame, ips: DataFrame) -> DataFrame:
    """Addresses asked to be removed that are not in the state."""
    return ips.select("ip").distinct().join(state.select("ip"), "ip", "left_anti")


def toggle_blacklist(state: DataFrame, commands: DataFrame, as_of: int) -> DataFrame:
    """Apply `ip, confirmed, seq` commands: each flips the deny flag; an address on
    the allow list moves over only when confirmed; an unknown one is added."""
    return _toggle(state, commands, as_of, "blacklisted", "whitelisted")


def toggle_whitelist(state: DataFrame, commands: DataFrame, as_of: int) -> DataFrame:
    """Mirror image of `toggle_blacklist`."""
    return _toggle(state, commands, as_of, "whitelisted", "blacklisted")


def _toggle(state: DataFrame, commands: DataFrame, as_of: int, flag: str, other: str) -> DataFrame:
    # On the other list, commands do nothing up to the first confirmed one, which moves
    # the address over; from then on, and without the other flag, every command flips.
    # So two counts per address settle the result, however many commands there are.
    first_ok = commands.filter("confirmed").groupBy("ip").agg(F.min("seq").alias("moved_at"))
    on_other = state.filter(F.col(other)).select("ip").withColumn("on_other", F.lit(True))
    each = commands.groupBy("ip", "seq").agg(F.count("*").alias("n"))
    counts = commands.groupBy("ip").agg(F.count("*").alias("n"))
    counted = (
        salted_join(each, first_ok, "ip", counts)
        .groupBy("ip")
        .agg(
            F.sum("n").alias("flips"),
            F.max(F.col("moved_at").isNotNull()).alias("moved"),
            F.coalesce(F.sum(F.when(F.col("seq") > F.col("moved_at"), F.col("n"))), F.lit(0)).alias("flips_after"),
        )
        .join(on_other, "ip", "left")
    )
    was = state.select(*STATE_COLUMNS)
    added = counted.join(was, "ip", "left_anti").select(*new_address(F.col("ip"), F.lit(as_of)))
    started_on_other = F.coalesce("on_other", F.lit(False))
    moved = started_on_other & F.col("moved")
    new_flag = (
        F.when(F.col("flips").isNull() | (started_on_other & ~F.col("moved")), F.col(flag))
        .when(moved, F.col("flips_after") % 2 == 0)
        .otherwise(F.col(flag) != (F.col("flips") % 2 == 1))
    )
    new_other = F.when(F.coalesce(moved, F.lit(False)), F.lit(False)).otherwise(F.col(other))
    return (
        was.unionByName(added)
        .join(counted, "ip", "left")
        .withColumn("new_flag", new_flag)
        .withColumn(other, new_other)
        .withColumn(flag, F.col("new_flag"))
        .select(*STATE_COLUMNS)
    )
