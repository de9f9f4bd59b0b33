import random
import re

import pytest
from pyspark.sql import functions as F

from logwarden import schemas
from logwarden.operators import match, rule_index, rules


def rule_table(spark, patterns):
    rows = [("G", 0, "activity", k, p, 1, True, [], None) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, schemas.RULES)


def hits_of(spark, lines, patterns):
    found = match.match_rules(lines, rule_table(spark, patterns))
    return sorted((r["seq"], r["rule_idx"], r["ip"], r["port"]) for r in found.collect())


def test_index_and_bare_list_find_the_same(spark, monkeypatch):
    """Texts that begin with each other, lie within each other, are shared by many rules, or
    that no rule requires; small and capital letters; rules that never match."""
    pick = random.Random(8)
    words = ["ab", "abc", "bc", "bcd", "user", "use", "Us%r", "x.y", "[z]", "it's", "a\\b", "é"]
    text = lambda n: " ".join(pick.choice(words) for _ in range(pick.randint(1, n)))
    patterns = [rf"^.*{re.escape(text(2))} %i.*" for _ in range(60)]
    patterns += [rf"^.*{re.escape(text(2))}.* from %i port %p" for _ in range(60)]
    patterns += [r"^\w+ %i", r"^(?:ab|bc) (?:x|y)* %i .*", r"^.*\Quser\E %i.*"]
    pick.shuffle(patterns)
    lines = [f"{text(4)} {pick.choice(['', 'from '])}10.0.0.{k % 250}{pick.choice(['', ' port 22', ' tail'])}" for k in range(600)]
    lines += ["", "ab", "ABC 10.0.0.1", "USER 10.0.0.2", "\u0130 bc 10.0.0.3"]
    table = spark.createDataFrame([("G", 1, n, t) for n, t in enumerate(lines)], "log_group string, ts long, seq long, line string")
    indexed = hits_of(spark, table, patterns)
    monkeypatch.setattr(match, "INDEXED_FROM", 10_000)
    assert indexed == hits_of(spark, table, patterns)
    assert len(indexed) > 100


def test_no_rule_requires_text(spark, monkeypatch):
    monkeypatch.setattr(match, "INDEXED_FROM", 1)
    table = spark.createDataFrame([("G", 1, 1, "q 10.0.0.1"), ("G", 1, 2, None)], "log_group string, ts long, seq long, line string")
    assert hits_of(spark, table, [r"^\d %i", r"^\w %i", r"^. %i"]) == [(1, 1, "10.0.0.1", None)]


def test_keys_are_the_rarest_texts():
    assert rule_index.keys_of([["sshd[", "invalid"], ["sshd[", "root"], [], ["sshd["]]) == ["invalid", "root", None, "sshd["]


def test_tree_pattern_finds_the_longest():
    texts = {"a", "abc", "abd", "b.c", "b|", "it's"}
    found = re.compile(f"(?=({rule_index.tree_pattern(texts)}))")
    for line in ("abcabdab", "xb.cb|it's", "", "b"):
        want = [max((t for t in texts if line.startswith(t, k)), key=len, default=None) for k in range(len(line))]
        assert [m[1] for m in found.finditer(line)] == [w for w in want if w]


@pytest.mark.parametrize(("pattern", "java"), [
    ("[[:digit:]a[:digit:]]+ %i", r"[\p{Digit}a\p{Digit}]+ %i"),
    ("[[:alpha:][:digit:]_[:alpha:]]x[^[:digit:]] %i", r"[\p{Alpha}\p{Digit}_\p{Alpha}]x[^\p{Digit}] %i"),
    (r"\[[:digit:] [a[:d:]] %i", r"\[[:digit:] [a\d] %i"),
    ("[:digit:] %i", "[:digit:] %i"),
])
def test_named_classes_repeat_within_a_bracket(spark, pattern, java):
    row = spark.range(1).select(rules.java_pattern(F.lit(pattern)).alias("java")).first()
    assert row["java"] == java
