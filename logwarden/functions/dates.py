"""Date functions (F3, F12). Epoch seconds are UTC; the session zone must be UTC too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.core import as_column

FORMATTED_LIMIT = 29

# Strftime codes and the Spark pattern for each.
STRFTIME_CODES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "p": "a",
    "j": "DDD",
    "b": "MMM",
    "h": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
    "R": "HH:mm",
    "D": "MM/dd/yy",
    "z": "xx",
    "Z": "z",
}


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch of a timestamp, with or without time zone."""
    return F.unix_seconds(as_column(ts).cast("timestamp"))


# Codes that stand for several others.
COMPOSED = {"c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "r": "%I:%M:%S %p"}


def _padded(number: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(number.cast("string"), width, fill)


def _computed(code: str, stamp: Column) -> Column | None:
    """Codes that Spark has no pattern letter for: weeks, numbers of days, blank padding."""
    weekday = F.dayofweek(stamp) - 1  # Sunday is 0
    iso_year = F.date_part(F.lit("YEAROFWEEK"), stamp)
    day = F.dayofyear(stamp) - 1
    values = {
        "U": lambda: _padded(F.floor((day + 7 - weekday) / 7), 2),
        "W": lambda: _padded(F.floor((day + 7 - (weekday + 6) % 7) / 7), 2),
        "V": lambda: _padded(F.weekofyear(stamp), 2),
        "G": lambda: _padded(iso_year, 4),
        "g": lambda: _padded(iso_year % 100, 2),
        "u": lambda: ((weekday + 6) % 7 + 1).cast("string"),
        "w": lambda: weekday.cast("string"),
        "e": lambda: _padded(F.dayofmonth(stamp), 2, " "),
        "k": lambda: _padded(F.hour(stamp), 2, " "),
        "l": lambda: _padded((F.hour(stamp) + 11) % 12 + 1, 2, " "),
        "s": lambda: F.unix_seconds(stamp).cast("string"),
        "C": lambda: _padded(F.floor(F.year(stamp) / 100), 2),
        "P": lambda: F.lower(F.date_format(stamp, "a")),
    }
    return values[code]() if code in values else None


def strftime(stamp: Column, fmt: str) -> Column:
    """A timestamp printed with a strftime format. ``%E`` and ``%O`` do not change the code they
    stand before; codes that do not exist come out as they are."""
    parts: list[Column] = []
    pattern = ""

    def flush() -> None:
        nonlocal pattern
        if pattern:
            parts.append(F.date_format(stamp, pattern))
        pattern = ""

    pending = list(fmt)
    literal = ""
    while pending:
        char = pending.pop(0)
        if char != "%" or not pending:
            literal += char
            continue
        code = pending.pop(0)
        if code in "EO" and pending and pending[0].isalpha():
            code = pending.pop(0)
        if code in COMPOSED:
            pending[:0] = COMPOSED[code]
        elif code in STRFTIME_CODES:
            pattern += _quoted(literal) + STRFTIME_CODES[code]
            literal = ""
        elif (value := _computed(code, stamp)) is not None:
            pattern += _quoted(literal)
            literal = ""
            flush()
            parts.append(value)
        else:
            literal += {"%": "%", "n": "\n", "t": "\t"}.get(code, "%" + code)
    pattern += _quoted(literal)
    flush()
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _quoted(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'" if literal else ""


def format_epoch(seconds, fmt: str) -> Column:
    """Epoch seconds printed with a strftime format, at most 29 characters."""
    return F.left(strftime(F.timestamp_seconds(as_column(seconds)), fmt), F.lit(FORMATTED_LIMIT))


def parse_offset_ts(text) -> Column:
    """ISO datetime with optional `±hh:mm` to epoch seconds; NULL when it cannot be read."""
    return F.unix_seconds(F.try_to_timestamp(as_column(text)))
