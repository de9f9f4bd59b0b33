"""Text functions (F1, F2, F6, F8-F11, F13-F17) and saturating addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.core import as_column, let, replace_first
from logwarden.settings import COMMENT_LIMIT, MAX_FEED_SCORE, MIN_FEED_SCORE, U32_MAX

BLANKS = " \t\n\r"


def trim_left(text) -> Column:
    """Drop leading blanks; text of blanks only stays as it is."""
    text = as_column(text)
    return F.when(text.rlike("[^ \t\n\r]"), F.ltrim(text, F.lit(BLANKS))).otherwise(text)


def trim_right(text) -> Column:
    """Drop trailing blanks; text of blanks only stays as it is."""
    text = as_column(text)
    return F.when(text.rlike("[^ \t\n\r]"), F.rtrim(text, F.lit(BLANKS))).otherwise(text)


def to_lower(text) -> Column:
    return F.lower(as_column(text))


def sat_add_u32(a: Column, b: Column) -> Column:
    """Addition that stops at the largest unsigned 32-bit value."""
    return F.least(a + b, F.lit(U32_MAX))


def mask(text, strings) -> Column:
    """Overwrite every occurrence of each string (an array, in order) with `*`."""
    stars = F.aggregate(
        F.filter(as_column(strings), lambda s: F.length(s) > 0),
        as_column(text),
        lambda acc, s: F.replace(acc, s, F.repeat(F.lit("*"), F.length(s))),
    )
    return F.when(as_column(strings).isNull(), as_column(text)).otherwise(stars)


def render_comment(template: Column, ip: Column, port: Column, line: Column, now: Column) -> Column:
    """Fill the first `%i`, `%p`, `%m` and `%d`, in that order, so that a later
    placeholder may also be found inside text put in for an earlier one. Without a
    port `%p` stays."""
    filled = replace_first(template, "%i", ip)
    filled = let(filled, lambda c: F.when(port.isNotNull(), replace_first(c, "%p", port.cast("string"))).otherwise(c))
    filled = let(filled, lambda c: replace_first(c, "%m", line))
    return let(filled, lambda c: replace_first(c, "%d", now))


def truncate_comment(comment) -> Column:
    return F.left(as_column(comment), F.lit(COMMENT_LIMIT))


def categories_csv(categories) -> Column:
    return F.array_join(as_column(categories), ",")


def report_payload(categories, comment, ip) -> Column:
    """Form body of one report request."""
    encoded = F.replace(F.url_encode(as_column(comment)), F.lit("+"), F.lit("%20"))
    encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(
        F.lit("categories="), categories_csv(categories), F.lit("&comment="), encoded, F.lit("&ip="), as_column(ip)
    )


def parse_headers(raw) -> Column:
    """`Key: value` lines to a map; the first of several equal keys wins."""

    def entry(line: Column) -> Column:
        at = F.locate(":", line)
        key = F.substring(line, F.lit(1), at - 1)
        value = F.substring(line, at + 1, F.length(line))
        return F.struct(trim_right(trim_left(key)).alias("key"), trim_right(trim_left(value)).alias("value"))

    lines = F.filter(F.split(as_column(raw), "\n"), lambda s: F.contains(s, F.lit(":")))
    entries = F.filter(F.transform(lines, entry), lambda e: F.length(e["key"]) > 0)
    return let(
        entries,
        lambda all_entries: F.map_from_entries(
            F.filter(
                all_entries,
                lambda e, i: F.array_position(F.transform(all_entries, lambda x: x["key"]), e["key"]) == i + 1,
            )
        ),
    )


def header_value(headers, name: str) -> Column:
    """Value of the first header, by key order, with this name in any case."""
    matching = F.filter(F.map_entries(as_column(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(F.array_sort(matching), F.lit(0))["value"]


def parse_categories(csv) -> Column:
    """`'15,21'` to integers; a token that is no number ends the list."""
    leading_number = r"^[ \t\n\r\f\x0B]*\+?(\d+)"
    numbers = F.transform(
        F.split(as_column(csv), ","), lambda t: F.regexp_extract(t, leading_number, 1).try_cast("int")
    )
    parsed = let(
        numbers,
        lambda n: F.when(
            F.exists(n, lambda x: x.isNull()),
            F.slice(n, F.lit(1), F.array_position(F.transform(n, lambda x: x.isNull()), F.lit(True)).cast("int") - 1),
        ).otherwise(n),
    )
    return F.coalesce(parsed, F.array().cast("array<int>"))


def parse_uint(text) -> Column:
    """Leading digits as a number, 0 when there are none."""
    digits = F.regexp_extract(as_column(text), r"^[ \t\n\r\f\x0B]*\+?(\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_tristate(text) -> Column:
    """true / false in any case; anything else means not set."""
    low = F.lower(as_column(text))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def clamp_feed_score(score) -> Column:
    return F.greatest(F.lit(MIN_FEED_SCORE), F.least(F.lit(MAX_FEED_SCORE), as_column(score)))


def clamp_confidence(confidence) -> Column:
    return F.least(F.lit(MAX_FEED_SCORE), as_column(confidence))
