"""Rule compilation (P1, P5) and the settings each rule resolves to."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.core import replace_first
from logwarden.functions.net import IP_PATTERN, PORT_PATTERN
from logwarden.settings import Settings


# Named character classes as rules write them, and as Java does. Rules
# ignore case, and so do their classes of capital and small letters.
NAMED_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Alpha}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}",
    "upper": r"\p{Alpha}", "xdigit": r"\p{XDigit}", "d": r"\d", "s": r"\s", "w": r"\w",
}
# Escapes that stand for something else than the characters they are written with.
_ESCAPE = re.compile(
    r"\\(?:x\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|0[0-7]{1,3}|c.|[pPN]\{[^}]*\}|[pP].|k<[^>]*>|[0-9]+|[A-Za-z])", re.S
)


def java_pattern(pattern: Column) -> Column:
    """Named classes within brackets, such as ``[[:digit:]]``, in Java's spelling. A match goes
    on from the one before it (``\\G``) within the same bracket, which may name a class twice."""
    for name, java in NAMED_CLASSES.items():
        opened = r"((?<!(?<!\\)\\)\[\^?|\G(?!\A))"
        inside = opened + r"((?:[^\[\]\\]|\\.|\[:[a-z]+:\])*?)\[:" + name + r":\]"
        pattern = F.regexp_replace(pattern, inside, "$1$2" + java.replace("\\", "\\\\"))
    return pattern


def compile_rules(rules: DataFrame) -> DataFrame:
    """Add ``regex``, ``port_pos`` (1 after the address, 2 before, -1 none) and the
    capture group numbers of address and port."""
    pattern = F.col("pattern")
    ip_at, port_at = F.locate("%i", pattern), F.locate("%p", pattern)
    port_pos = F.when(port_at == 0, -1).when(port_at > ip_at, 1).otherwise(2)
    with_port = replace_first(java_pattern(pattern), "%p", F.lit(PORT_PATTERN))
    return (
        rules.filter(ip_at > 0)
        .withColumn("port_pos", port_pos)
        .withColumn("regex", replace_first(with_port, "%i", F.lit(f"({IP_PATTERN})")))
        .withColumn("ip_group", _groups_before(ip_at) + F.when(F.col("port_pos") == 2, 2).otherwise(1))
        .withColumn(
            "port_group",
            F.when(F.col("port_pos") == 1, _groups_before(port_at) + 2).when(
                F.col("port_pos") == 2, _groups_before(port_at) + 1
            ),
        )
    )


def _groups_before(position: Column) -> Column:
    """Number of the user's own capture groups opened before ``position``."""
    prefix = F.substring(F.col("pattern"), F.lit(1), position - 1)
    plain = F.regexp_replace(F.regexp_replace(prefix, r"\\.", ""), r"\[[^\]]*\]", "")
    return F.regexp_count(plain, F.lit(r"\((?!\?)"))


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rules that cannot be used, with the reason: no ``%i``, or a pattern that the engine
    which runs it does not compile (:func:`compile_error` says why). Patterns are compiled where
    their rows are."""
    key = ["log_group", "group_idx", "kind", "rule_idx"]
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex"), F.lit(2))
    broken = compile_rules(rules).filter(compiled.isNull()).select(*key, F.lit("pattern does not compile").alias("error"))
    missing = rules.filter(F.locate("%i", "pattern") == 0).select(*key, F.lit("no address placeholder in pattern").alias("error"))
    return missing.unionByName(broken)


def usable_rules(rules: DataFrame) -> list:
    """Compiled rules in matching order, on the driver: they become column
    expressions, so the list is as long as the rule configuration."""
    compiled = compile_rules(rules).orderBy("group_idx", "log_group", "kind", "rule_idx").collect()
    return [r for r in compiled if compile_error(rules.sparkSession, r["regex"]) is None]


def compile_error(spark: SparkSession, regex: str) -> str | None:
    """What Java, which runs the rules, has against a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex, 2)
    except IllegalArgumentException as error:
        return str(error).split(" near index")[0].splitlines()[0]
    return None


def _class_end(pattern: str, begin: int) -> int:
    """Position behind the bracket expression that begins there; -1 if it does not end."""
    i, depth = begin + 1, 1
    if pattern.startswith("^", i):
        i += 1
    if pattern.startswith("]", i):  # engines differ here: nothing is certain
        return -1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        depth += {"[": 1, "]": -1}.get(pattern[i], 0)
        i += 1
        if depth == 0:
            return i
    return -1


def required_texts(pattern: str) -> list[str]:
    """Literals that every line matching ``pattern`` contains, lower-cased, longest
    first; empty when none is certain."""
    if "\\Q" in pattern or re.search(r"\(\?[a-zA-Z-]*x", pattern):  # quoted stretches, free spacing
        return []
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        char = pattern[i]
        step, literal = 1, ""
        if char == "\\" and i + 1 < len(pattern):
            escape = _ESCAPE.match(pattern, i)
            step = escape.end() - i if escape else 2
            literal = "" if escape else pattern[i + 1]
        elif pattern.startswith(("%i", "%p"), i):
            step = 2
        elif char == "[":
            close = _class_end(pattern, i)
            if close < 0:
                return []
            step = close - i
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            return []
        elif char not in ".^$|*+?{}":
            literal = char
        follower = pattern[i + step : i + step + 1]
        if literal and depth == 0 and literal.isascii() and (not follower or follower not in "*+?{"):
            run += literal
        else:
            runs.append(run)
            run = ""
            if char == "{":
                close = pattern.find("}", i)
                step = close - i + 1 if close > 0 else 1
        i += step
    return sorted({r.lower() for r in [*runs, run] if len(r) > 1}, key=lambda r: (-len(r), r))


def resolve_report_settings(rules: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Effective report flag, categories and comment of every rule: the rule's own
    value, else its group's, else the global one. '' is a value for a comment. Groups of
    one name are told apart by their place in the configuration."""
    group = groups.select(
        "log_group",
        "group_idx",
        F.col("report").alias("group_report"),
        F.col("categories").alias("group_categories"),
        F.col("comment").alias("group_comment"),
    )
    default_categories = F.array(*[F.lit(c) for c in settings.default_categories]).cast("array<int>")

    def given(column: str) -> Column:
        return F.when(F.size(column) > 0, F.col(column))

    return (
        rules.join(group, ["log_group", "group_idx"], "left")
        .withColumn("report", F.coalesce("report", "group_report", F.lit(settings.report_all)))
        .withColumn("categories", F.coalesce(given("categories"), given("group_categories"), default_categories))
        .withColumn("comment", F.coalesce("comment", "group_comment", F.lit(settings.default_comment), F.lit("")))
        .select(*rules.columns)
    )
