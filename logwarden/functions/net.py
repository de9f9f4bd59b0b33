"""Address functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.core import as_column, let

# What `%i` and `%p` stand for in a rule pattern.
IP_PATTERN = r"(?:(?:[0-9a-f]{1,4}:){6}|::(?:[0-9a-f]{1,4}:){5}|(?:[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:){4}|(?:(?:[0-9a-f]{1,4}:){0,1}[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:){3}|(?:(?:[0-9a-f]{1,4}:){0,2}[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:){2}|(?:(?:[0-9a-f]{1,4}:){0,3}[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:)|(?:(?:[0-9a-f]{1,4}:){0,4}[0-9a-f]{1,4})?::)(?:[0-9a-f]{1,4}:[0-9a-f]{1,4}|(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])))|(?:(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4})?::[0-9a-f]{1,4}|(?:(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})?::|(?:(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))"
PORT_PATTERN = r"(\d{1,5})"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = "[0-9a-f]{1,4}"


def _v6_pattern() -> str:
    """Full and `::`-shortened v6 text, with an optional dotted tail."""
    forms = [f"(?:{_HEX}:){{7}}{_HEX}", f"(?:{_HEX}:){{6}}{_V4}"]
    for left in range(8):
        room = 7 - left
        head = f"{_HEX}(?::{_HEX}){{{left - 1}}}" if left else ""
        tails = []
        if room >= 1:
            tails.append(f"{_HEX}(?::{_HEX}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(f"(?:{_HEX}:){{0,{room - 2}}}{_V4}")
        forms.append(f"{head}::(?:{'|'.join(tails)})?" if tails else f"{head}::")
    return "|".join(forms)


STRICT_V4 = rf"\A{_V4}\z"
STRICT_V6 = rf"\A(?:{_v6_pattern()})\z"


def _dotted_tail_to_hex(text: Column) -> Column:
    def octet(i: int) -> Column:
        return F.regexp_extract(text, r"(\d+)\.(\d+)\.(\d+)\.(\d+)\z", i).cast("int")

    def pair(i: int) -> Column:
        return F.lower(F.hex(octet(i) * 256 + octet(i + 1)))

    head = F.regexp_extract(text, r"\A(.*:)[0-9.]+\z", 1)
    return F.when(F.contains(text, F.lit(".")), F.concat(head, pair(1), F.lit(":"), pair(3))).otherwise(text)


def _fill_gap(text: Column) -> Column:
    """Write out the groups that `::` stands for."""
    missing = 8 - F.regexp_count(text, F.lit("[0-9a-f]+"))
    filled = F.replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing)))
    return F.when(F.contains(text, F.lit("::")), F.trim(filled, F.lit(":"))).otherwise(text)


def _shorten(groups: Column) -> Column:
    """Collapse the longest run (at least two, leftmost first) of zero groups to `::`."""
    framed = F.concat(F.lit(":"), groups, F.lit(":"))
    result = groups
    for run in range(2, 9):
        zeros = ":" + "0:" * run
        at = F.locate(zeros, framed)
        head = F.substring(framed, F.lit(2), at - 2)
        tail = F.rtrim(F.substring(framed, at + len(zeros), F.length(framed)), F.lit(":"))
        result = F.when(at > 0, F.concat(F.when(at > 1, head).otherwise(""), F.lit("::"), tail)).otherwise(result)
    return result


def _embedded_v4(groups: Column, prefix: str) -> Column:
    def value(i: int) -> Column:
        return F.conv(F.split_part(groups, F.lit(":"), F.lit(i)), 16, 10).cast("int")

    def dotted(n: Column) -> Column:
        return F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))

    return F.concat(F.lit(prefix), dotted(value(7)), F.lit("."), dotted(value(8)))


def _canonical(groups: Column) -> Column:
    return (
        F.when(groups.rlike(r"\A(?:0:){6}(?!0:)"), _embedded_v4(groups, "::"))
        .when(groups.rlike(r"\A(?:0:){5}ffff:"), _embedded_v4(groups, "::ffff:"))
        .otherwise(_shorten(groups))
    )


def ip6_format(ip) -> Column:
    """Canonical lower-case compressed v6 text; NULL when ``ip`` is not a v6 address."""
    low = F.lower(as_column(ip))
    expanded = let(_dotted_tail_to_hex(low), _fill_gap)
    stripped = F.regexp_replace(expanded, "(^|:)0+(?=[0-9a-f])", "$1")
    return F.when(low.rlike(STRICT_V6), let(stripped, _canonical))


def ip_version(ip) -> Column:
    """4, 6 or -1. Octets with leading zeros are not valid addresses."""
    text = as_column(ip)
    return (
        F.when(text.rlike(STRICT_V4), F.lit(4))
        .when(F.lower(text).rlike(STRICT_V6), F.lit(6))
        .otherwise(F.lit(-1))
    )


def normalize_ip(ip) -> Column:
    """v6 text in canonical form, anything without a colon as it is."""
    text = as_column(ip)
    return F.when(F.contains(text, F.lit(":")), ip6_format(text)).otherwise(text)
