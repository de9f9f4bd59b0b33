"""First matching rule per line.

The rule list is turned into one `CASE` per log group and rule kind, so matching is
a map-side projection: no join, no shuffle, constant patterns. A cheap search for
text the rule requires stands before each regex. Long lists go through `rule_index`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.net import ip_version as version_of
from logwarden.functions.net import normalize_ip
from logwarden.operators import rule_index
from logwarden.operators.rule_index import decision_tree, quoted
from logwarden.operators.rules import required_texts, usable_rules

HIT_COLUMNS = ["seq", "ts", "log_group", "kind", "rule_idx", "score", "ip", "ip_version", "port", "line", "group_idx"]


INDEXED_FROM = 64  # longer lists are searched through an index of their required texts


def match_line(line: Column, regex: str) -> Column:
    """Whole-line, case-insensitive match."""
    return line.rlike(whole_line(regex))


def whole_line(regex: str) -> str:
    return f"(?i)\\A(?:{regex})\\z"


def match_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """One hit per line and rule kind: the first rule of the line's group that
    matches. Activity and refused rules are tried independently.

    ``lines`` has ``log_group, ts, seq, line``; ``ts`` is epoch seconds. A configuration may
    have several groups of one name: where ``lines`` has ``group_idx`` too, it says which one
    a line belongs to, else the rules of all of them are tried in order. ``group_idx`` of a
    hit is the group of its rule.
    """
    usable = usable_rules(rules)
    key = "group_idx" if "group_idx" in lines.columns else "log_group"
    if not usable:
        firsts = [F.lit(None).cast("int")]
    else:
        numbered = list(enumerate(usable))
        kinds = sorted({r["kind"] for r in usable})
        firsts = [F.expr(_first_in_group([x for x in numbered if x[1]["kind"] == k], key)) for k in kinds]
    firsts = [first.alias(f"rule_{n}") for n, first in enumerate(firsts)]
    searched = lines.select("seq", "ts", "log_group", "line", *firsts)
    per_hit = searched.select(
        "seq", "ts", "log_group", "line", F.explode(F.array(*searched.columns[4:])).alias("rule_pos")
    ).filter(F.col("rule_pos").isNotNull())
    cut = per_hit.select("*", F.split(F.expr(_fields_of(usable)), "\n").alias("found"))
    return cut.select(
        "seq",
        "ts",
        "log_group",
        _lookup([r["kind"] for r in usable], "string").alias("kind"),
        _lookup([r["rule_idx"] for r in usable], "int").alias("rule_idx"),
        _lookup([r["score"] for r in usable], "bigint").alias("score"),
        normalize_ip(F.col("found")[0]).alias("ip"),
        F.nullif(F.col("found")[1], F.lit("")).cast("int").alias("port"),
        "line",
        _lookup([r["group_idx"] for r in usable], "int").alias("group_idx"),
    ).select(*[c if c != "ip_version" else version_of("ip").alias(c) for c in HIT_COLUMNS])


def _first_in_group(numbered: list, key: str) -> str:
    """Number of the first matching rule among those of the line's own group."""
    groups: dict = {}
    for x in numbered:
        groups.setdefault(x[1][key], []).append(x)
    branches = [
        f"WHEN {key} = {quoted(group) if key == 'log_group' else group} THEN {_first_match(members)}"
        for group, members in groups.items()
    ]
    return f"CASE {' '.join(branches)} END"


def _first_match(numbered: list) -> str:
    if len(numbered) > INDEXED_FROM:
        return rule_index.first_match(numbered, lambda regex: f"line RLIKE {quoted(whole_line(regex))}")
    texts = [required_texts(r["pattern"]) for _, r in numbered]
    shared = shared_text(texts)
    branches = []
    for (n, r), required in zip(numbered, texts, strict=True):
        tests = [f"contains(low, {quoted(t)})" for t in required if t != shared]
        tests.append(f"line RLIKE {quoted(whole_line(r['regex']))}")
        branches.append(f"WHEN {' AND '.join(tests)} THEN {n}")
    first = f"CASE {' '.join(branches)} END"
    if shared:
        first = f"CASE WHEN contains(low, {quoted(shared)}) THEN {first} END"
    return f"element_at(transform(array(lower(line)), low -> {first}), 1)"


def _fields_of(usable: list) -> str:
    """Address and port cut out by one run of the matched rule's regex, a line feed
    between them."""
    def cut(item) -> str:
        _, r = item
        port = f"${r['port_group']}" if r["port_pos"] != -1 else ""
        fields = f"${r['ip_group']}\n{port}"
        return f"regexp_replace(line, {quoted(whole_line(r['regex']))}, {quoted(fields)})"

    picked = decision_tree(list(enumerate(usable)), "n", cut, lambda item: str(item[0])) if usable else "cast(n AS string)"
    return f"element_at(transform(array(rule_pos), n -> {picked}), 1)"


def shared_text(texts: list[list[str]]) -> str:
    """The longest text that every rule of the list requires; one search for it spares
    all of them on most lines."""
    common = set(texts[0]).intersection(*texts[1:])
    return max(sorted(common), key=len, default="")


def _lookup(values: list, type_: str) -> Column:
    items = ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values)
    return F.expr(f"get(cast(array({items}) AS array<{type_}>), rule_pos)")
