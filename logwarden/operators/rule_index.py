"""Matching against long rule lists: a literal index.

Every rule that requires some text waits under the rarest of its required texts. One pass
over a line finds, at each place, the longest of these texts that begins there: the texts are
laid out as a tree of their common beginnings, so a place costs a step or two however many
rules there are. What was found names the rules that can match, and only their regexes run,
in the order of the list. Rules that require no text always run. All of it is a column
expression, as for short lists.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from logwarden.operators.rules import required_texts


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def decision_tree(items: Sequence, variable: str, leaf: Callable[[object], str], bound: Callable[[object], str]) -> str:
    """One of ``items``, which are in order, by comparing ``variable`` with their bounds: as
    many comparisons as the list has binary digits, where a CASE tries one after the other."""
    if len(items) == 1:
        return leaf(items[0])
    middle = len(items) // 2
    low, high = (decision_tree(part, variable, leaf, bound) for part in (items[:middle], items[middle:]))
    return f"IF({variable} < {bound(items[middle])}, {low}, {high})"


def keys_of(texts: list[list[str]]) -> list[str | None]:
    """For each rule the text it waits under: the one fewest rules require, of these the
    longest; None where it requires none."""
    wanted = Counter(t for required in texts for t in set(required))
    return [min(required, key=lambda t: (wanted[t], -len(t), t), default=None) for required in texts]


def tree_pattern(texts: set[str]) -> str:
    """A regex for the longest of ``texts`` that begins at a place."""
    tree: dict = {}
    for text in texts:
        node = tree
        for char in text:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:  # no choice here
            (char, node), = node.items()
            out += _escaped(char)
        choices = [_escaped(c) + written(n) for c, n in sorted(node.items()) if c]
        if not choices:
            return out
        return out + "(?:" + "|".join(choices) + ")" + ("?" if "" in node else "")

    return written(tree)


def _escaped(char: str) -> str:
    return char if char.isalnum() else f"\\x{ord(char):02x}"


def first_match(numbered: list, test: Callable[[str], str]) -> str:
    """SQL for the number of the first of the rules (number, row) that match ``line``.
    ``test``: SQL of running a regex. ``low`` in it is the line in small letters."""
    texts = [required_texts(r["pattern"]) for _, r in numbered]
    keys = keys_of(texts)
    waiting: dict[str, list[int]] = {}
    for (n, _), key in zip(numbered, keys, strict=True):
        if key is not None:
            waiting.setdefault(key, []).append(n)
    always = f"array({', '.join(str(n) for (n, _), key in zip(numbered, keys, strict=True) if key is None)})"
    if waiting:
        # At one place only the longest text is found; those it begins with are there too.
        named = {
            key: sorted(n for k in range(1, len(key) + 1) for n in waiting.get(key[:k], [])) for key in waiting
        }
        found = f"array_distinct(regexp_extract_all(low, {quoted('(?=(' + tree_pattern(set(waiting)) + '))')}, 1))"
        rules_of = decision_tree(
            sorted(named.items()), "word", lambda item: f"array({', '.join(map(str, item[1]))})", lambda item: quoted(item[0])
        )
        candidates = f"array_sort(array_distinct(concat(flatten(transform({found}, word -> {rules_of})), cast({always} AS array<int>))))"
    else:
        candidates = always

    def tried(item) -> str:
        (_, rule), required, key = item
        tests = [f"contains(low, {quoted(t)})" for t in required if t != key]
        return "(" + " AND ".join([*tests, test(rule["regex"])]) + ")"

    runs = decision_tree(list(zip(numbered, texts, keys, strict=True)), "n", tried, lambda item: str(item[0][0]))
    first = f"aggregate(cast({candidates} AS array<int>), cast(NULL AS int), (first, n) -> IF(first IS NULL AND {runs}, n, first))"
    return f"element_at(transform(array(lower(line)), low -> {first}), 1)"
