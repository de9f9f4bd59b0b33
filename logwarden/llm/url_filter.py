"""URL filters: pattern rules indexed by their rarest literal token.

A rule needs the words it spells out, so a url can only fit rules of whose words it has all;
each rule waits under the one of its words that the fewest rules have. The words of a url
fetch the rules that wait there, and regular expressions run on those alone. All of it is
DataFrame expressions, joins and grouped maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_LIST = 100_000  # rules; a longer list is joined by a shuffle

# Listed rules (verdict, host, path), and the method's own for urls that fit none of them
# (verdict, name, words it spells out, regular expression over host and path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
PATTERNS = [
    ("block", "advert host", ["ads", "track"], r"^([^/]*[.-])?ads-track[.-]"),
    ("block", "tracker host", ["tracker"], r"^([^/]*[.-])?tracker[.-]"),
    ("block", "login page", ["login"], r"(?i)/login([/.]|$)"),
    ("block", "sign-up page", ["signup"], r"(?i)/signup([/.]|$)"),
    ("block", "shopping cart", ["cart"], r"(?i)/cart([/.]|$)"),
    ("block", "checkout", ["checkout"], r"(?i)/checkout([/.]|$)"),
    ("block", "script folder", ["cgi", "bin"], r"(?i)/cgi-bin/"),
    ("block", "administration", ["wp", "admin"], r"(?i)/wp-admin([/.]|$)"),
]
OTHERWISE = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, in lower case, each once."""
    return F.array_distinct(F.filter(F.split(_fold(text), "[^a-z0-9]+"), lambda t: t != ""))


def host_rules(rules: DataFrame) -> DataFrame:
    """(verdict, host, path) as pattern rules. They fit the host and its subdomains, and
    paths with that beginning. The last word of a path may go on in the url, so only words
    with a mark behind them are spelled out. Null parts are empty; repeated rules count
    once; of two that differ in the verdict alone, block holds."""
    host, path = _fold(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    quoted = F.regexp_replace(F.concat(host, path), "([^A-Za-z0-9])", r"\\$1")
    behind = F.when(path == "", F.lit("(?=/|\\z)")).otherwise("")
    whole = F.concat(host, F.lit("/"), F.regexp_replace(path, "[A-Za-z0-9]+$", ""))
    return rules.select(
        F.lit(0).alias("tier"), F.coalesce("verdict", F.lit("block")).alias("verdict"), F.concat(host, path).alias("rule"),
        tokens(whole).alias("words"), F.concat(F.lit("^(?:[^/]*\\.)?"), quoted, behind).alias("pattern"),
    ).groupBy("tier", "rule", "words", "pattern").agg(F.max("verdict").alias("verdict"))


def pattern_rules(rules: DataFrame) -> DataFrame:
    """(verdict, name, words, pattern) as rules that stand behind the listed ones."""
    return rules.select(F.lit(1).alias("tier"), F.col("name").alias("rule"), "words", "pattern", "verdict").distinct()


def indexed(rules: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the word under which a rule waits: of its words the one
    that the fewest rules have, then the longest. A rule without words waits under the
    empty word, which every url has."""
    each = rules.select("tier", "rule", "pattern", F.explode("words").alias("word"))
    known = each.groupBy("word").agg(F.count("*").alias("n"))
    rarest = each.join(known, "word").groupBy("tier", "rule", "pattern").agg(
        F.min(F.struct("n", (-F.length("word")).alias("l"), "word")).alias("best")
    )
    keys = ["tier", "rule", "pattern"]
    return rules.join(rarest, keys, "left").select(*keys, "verdict", F.coalesce("best.word", F.lit("")).alias("token"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty for null and for urls without a scheme."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    shape = "://([^/?#]*)([^?#]*)"
    return _fold(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``pattern`` (the method's own
    rule that fitted) for every row. A listed rule goes before a pattern, and the longest
    name wins among equals. Repeated urls are judged once, so a url that very many pages
    share costs one row after a combined grouping; repeated rows stay repeated."""
    host, path = parts(F.col("url"))
    source = pages.select("page_id", host.alias("host"), path.alias("path"))
    index = indexed(rules)
    if rules.count() <= SMALL_LIST:
        index = F.broadcast(index)
    text = F.concat("host", "path")
    words = source.select("host", "path").distinct().withColumn(
        "token", F.explode(F.concat(F.array(F.lit("")), tokens(text)))
    )
    fitting = words.join(index, "token").where(F.expr("concat(host, path) rlike pattern"))
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct((-F.col("tier")).alias("tier"), F.length("rule").alias("length"), "rule", "verdict")).alias("best")
    )
    return source.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.when(F.col("best.tier") == 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(OTHERWISE)).alias("verdict"),
        F.when(F.col("best.tier") < 0, F.col("best.rule")).alias("pattern"),
    )


def _values(spark: SparkSession, rows: list, names: str) -> DataFrame:
    def shown(value):
        if isinstance(value, list):
            return f"array({', '.join(map(shown, value))})"
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(shown, row)) + ')' for row in rows)} AS t({names})")


def report(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    listed = host_rules(_values(spark, RULES, "verdict, host, path"))
    own = pattern_rules(_values(spark, PATTERNS, "verdict, name, words, pattern"))
    return judged(pages, listed.unionByName(own))


_LISTED = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_OWN = ", ".join(f"('{v}', '{n}', '{p}')" for v, n, _, p in PATTERNS)
ORACLE = f"""
WITH u AS (
    SELECT row_number() OVER () AS r, page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages),
l AS (
    SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
    FROM u JOIN (VALUES {_LISTED}) AS t(v, h, p)
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY r),
o AS (
    SELECT r, arg_max(n, (length(n), n)) AS pattern, arg_max(v, (length(n), n)) AS verdict
    FROM u JOIN (VALUES {_OWN}) AS t(v, n, p) ON regexp_matches(host || path, p)
    GROUP BY r)
SELECT page_id, host, path, l.rule, coalesce(l.verdict, o.verdict, '{OTHERWISE}') AS verdict,
       CASE WHEN l.rule IS NULL THEN o.pattern END AS pattern
FROM u LEFT JOIN l USING (r) LEFT JOIN o USING (r)
"""
