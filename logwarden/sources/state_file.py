"""Import of fixed-width state files.

The first character of a line is its kind; the other fields have fixed places,
padded with spaces on the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.net import ip_version
from logwarden.functions.text import parse_uint, trim_left, trim_right
from logwarden.schemas import BOOKMARKS, FEED, FEED_META, STATE
from logwarden.settings import REMOVED_ROWS_BEFORE_COMPACTION
from logwarden.sources.logs import text_lines

# Record kinds, and first position (from 1) and length of each field.
KINDS = {"d": "address", "b": "bookmark", "a": "feed", "s": "feed_meta", "r": "removed"}
ADDRESS_FIELDS = {
    "ip": (2, 39),
    "last_activity": (41, 20),
    "score": (61, 10),
    "activity_count": (71, 10),
    "refused_count": (81, 10),
    "whitelisted": (91, 1),
    "blacklisted": (92, 1),
    "last_reported": (93, 20),
    "ip_version": (113, 1),
}
BOOKMARK_FIELDS = {"bookmark": (2, 20), "size": (22, 20), "path": (42, (1 << 31) - 1)}  # the path is the rest of the line
FEED_FIELDS = {"ip": (2, 39), "total_reports": (41, 10), "confidence": (51, 3), "ip_version": (54, 1)}
META_FIELDS = {"sync_time": (2, 20), "gen_time": (22, 20)}


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a state file, ``seq, line``, for the functions below."""
    return text_lines(spark, [path]).select("seq", "line")


def _field(place: tuple[int, int]) -> Column:
    return trim_left(F.substring("line", *place))


def _of_kind(lines: DataFrame, kind: str) -> DataFrame:
    return lines.filter(F.substring("line", 1, 1) == kind)


def _version(fields: dict) -> Column:
    """The version column where the line has one, else what the address looks like."""
    start = fields["ip_version"][0]
    given = F.when(F.length("line") == start, F.substring("line", start, 1))
    return F.when(given.isin("4", "6"), given.cast("int")).otherwise(ip_version(_field(fields["ip"])))


def address_rows(lines: DataFrame) -> DataFrame:
    """State columns with ``seq``, duplicates included. An address on both lists is on
    the allow list only."""
    f = ADDRESS_FIELDS
    values = {name: parse_uint(_field(place)) for name, place in f.items()}
    values["ip"] = _field(f["ip"])
    values["whitelisted"] = F.substring("line", *f["whitelisted"]) == "y"
    values["blacklisted"] = (F.substring("line", *f["blacklisted"]) == "y") & ~values["whitelisted"]
    values["last_reported"] = F.when(F.length("line") >= 112, values["last_reported"]).otherwise(0)
    values["ip_version"] = _version(f)
    values["has_rule"] = F.lit(False)
    columns = [values[c.name].cast(c.dataType).alias(c.name) for c in STATE.fields]
    return _of_kind(lines, "d").select("seq", *columns)


def feed_rows(lines: DataFrame) -> DataFrame:
    f = FEED_FIELDS
    values = {
        "ip": _field(f["ip"]),
        "total_reports": parse_uint(_field(f["total_reports"])),
        "confidence": parse_uint(_field(f["confidence"])),
        "ip_version": _version(f),
        "has_rule": F.lit(False),
    }
    return _of_kind(lines, "a").select("seq", *[values[c.name].cast(c.dataType).alias(c.name) for c in FEED.fields])


def bookmark_rows(lines: DataFrame) -> DataFrame:
    """Bookmarks; of several for one path the last counts."""
    f = BOOKMARK_FIELDS
    rows = _of_kind(lines, "b").select(
        "seq",
        trim_right(_field(f["path"])).alias("path"),
        parse_uint(_field(f["bookmark"])).alias("bookmark"),
        parse_uint(_field(f["size"])).alias("size"),
    )
    last = F.max_by(F.struct("bookmark", "size"), "seq").alias("last")
    return rows.groupBy("path").agg(last).select("path", "last.*").select(*BOOKMARKS.fieldNames())


def feed_meta_row(lines: DataFrame) -> DataFrame:
    """Sync times; of several records the last counts."""
    f = META_FIELDS
    values = F.struct(*[parse_uint(_field(f[c])).alias(c) for c in FEED_META.fieldNames()])
    return (
        _of_kind(lines, "s")
        .agg(F.max_by(values, "seq").alias("last"))
        .select(*[F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in FEED_META.fieldNames()])
    )


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """The first row of each address. Copies are dropped before the shuffle, so any
    number of them does no harm."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "seq"]), "seq").alias("first")
    return rows.groupBy("ip").agg(first).select("first.*")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Addresses that occur more than once, and how often."""
    return rows.groupBy("ip").agg(F.count("*").alias("copies")).filter("copies > 1")


def state_load_report(lines: DataFrame) -> DataFrame:
    """One row: records per kind, surplus copies, whether the old row layout occurs and
    whether the file is worth rewriting."""
    kind, length = F.substring("line", 1, 1), F.length("line")
    keyed = lines.select(
        kind.alias("kind"),
        F.when(kind.isin("d", "a"), _field(ADDRESS_FIELDS["ip"])).alias("ip"),
        (((kind == "d") & (length != 113)) | ((kind == "a") & (length != 54))).alias("old_layout"),
    )
    per_key = keyed.groupBy("kind", "ip").agg(F.count("*").alias("n"), F.max("old_layout").alias("old_layout"))

    def total(value: Column, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    return per_key.agg(
        total(F.lit(1), "d").alias("addresses"),
        total(F.lit(1), "a").alias("feed_rows"),
        total(F.col("n"), "r").alias("removed"),
        (total(F.col("n") - 1, "d") + total(F.col("n") - 1, "a")).alias("duplicates"),
        F.coalesce(F.max("old_layout"), F.lit(False)).alias("needs_upgrade"),
    ).withColumn(
        "rewrite",
        (F.col("duplicates") > 0) | F.col("needs_upgrade") | (F.col("removed") > REMOVED_ROWS_BEFORE_COMPACTION),
    )
