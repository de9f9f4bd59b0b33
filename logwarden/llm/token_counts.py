"""Token counts of every prefix of a text, by dynamic programming.

A byte pair encoding without its last token is again the encoding of the bytes it
covers, and two tokens may stand side by side exactly if encoding their joined bytes gives
those two back. So each prefix of a word has one possible last token: the one that fits
behind the last token of the prefix before it. Going from prefix to prefix gives the count
of all of them for the price of one encoding; counts over words add up.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from logwarden.llm import arrow, backtrack, segment

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
CACHED_WORDS = 1 << 18
CACHED_LENGTH = 64  # bytes of a word that is kept
END = "</w>"


class Counter:
    """Counts of words. Tokens are numbers; a token that ends a word is another one than
    the same bytes within a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = backtrack.byte_letters()

        def parsed(token: str) -> tuple[bytes, bool]:
            last = token.endswith(END) and token != END
            return bytes(letters[c] for c in (token[:-len(END)] if last else token)), last

        ids = {parsed(token): number for token, number in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = []
        for a, b in pairs:
            (x, inner), (y, last) = parsed(a), parsed(b)
            merges.append((ids[x, inner], ids[y, last], ids[x + y, last]))
        self.merges = backtrack.MergeRules(merges, max(ids.values()) + 1)
        # Every byte string that is a token: its number within a word, and at the end.
        tokens: dict[bytes, list[int]] = {}
        usable = self.merges.occurring(ids.values())
        for (raw, last), number in ids.items():
            if usable[number] and raw:
                tokens.setdefault(raw, [-1, -1])[last] = number
        self.automaton = ahocorasick.Automaton()
        for raw, (within, ending) in tokens.items():
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), within, ending))
        self.automaton.make_automaton()
        self.words: dict[bytes, bytes] = {}

    def prefixes(self, word: bytes) -> list[int]:
        """Tokens of the word ``word[:k]`` at place k - 1, for every k. One token can be the
        last of each prefix within the word, and one its last where the word ends there."""
        n, known, may_follow = len(word), self.merges.pairs, self.merges.may_follow
        last, inner, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end, (width, within, ending) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            begin = end - width
            left = last[begin] << 32
            if within >= 0 and last[end] < 0:
                fits = not begin or known.get(left | within)
                if fits is None:
                    fits = may_follow(left >> 32, within)
                if fits:
                    last[end], inner[end] = within, inner[begin] + 1
            if ending >= 0 and not closed[end]:
                fits = not begin or known.get(left | ending)
                if fits is None:
                    fits = may_follow(left >> 32, ending)
                if fits:
                    closed[end] = inner[begin] + 1
        return closed[1:]

    def inner(self, words: list[bytes]) -> list[bytes]:
        """Of each word the counts of its prefixes that end where a character ends, as 32-bit
        numbers."""
        found = list(map(self.words.get, words))
        new = {word for word, counts in zip(words, found) if counts is None}
        if not new:
            return found
        fresh = {}
        for word in new:
            counts = self.prefixes(word)
            if not word.isascii():
                counts = [c for k, c in enumerate(counts, 1) if k == len(word) or word[k] & 0xC0 != 0x80]
            fresh[word] = array("i", counts).tobytes()
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
        self.words.update((word, counts) for word, counts in fresh.items() if len(word) <= CACHED_LENGTH)
        return [fresh[word] if counts is None else counts for word, counts in zip(words, found)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def normalized(text: str, words: Counter) -> str:
    """As the vocabulary's own normalizer, which is asked where Python's rules for case or
    composition could differ."""
    if not text or max(text) < "̀":
        return unicodedata.normalize("NFC", text).lower()
    return words.normalizer.normalize_str(text)


def word_slices(texts: list[str], table: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts as bytes; per text how many precede it; where each word ends, in
    code points of its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-8")
    points = segment.code_points(np.frombuffer(joined, np.uint8))
    n = len(texts)
    rows = np.r_[0, np.cumsum(lengths)]
    symbols = np.full(len(points) + n, segment.BREAK, np.uint8)
    text = np.ones(len(symbols), bool)
    text[rows[:-1] + np.arange(n)] = False
    symbols[text] = kinds = table[points]
    starts = np.flatnonzero(segment.boundaries(symbols, lead=False)[text])
    stops = np.r_[starts[1:], len(points)][:len(starts)]
    filled = (kinds[starts] != segment.SPACE) & (kinds[starts] != segment.WHITE)
    starts, stops = starts[filled], stops[filled]
    places = np.r_[0, np.cumsum(segment.width(points), dtype=np.int64)]
    words = [joined[a:b] for a, b in zip(places[starts].tolist(), places[stops].tolist())]
    first = np.searchsorted(starts, rows)
    return words, first, stops - np.repeat(rows[:-1], np.diff(first))


def segments(text: str, words: Counter) -> list[str]:
    """The text cut at special strings, which count one token each and stand as None."""
    if "<|" not in text:
        return [text]
    out, begin = [], 0
    while True:
        hits = [(k, s) for s in words.special if (k := text.find(s, begin)) >= 0]
        if not hits:
            return [*out, text[begin:]]
        place, special = min(hits)
        out += [text[begin:place], None]
        begin = place + len(special)


def prefix_counts(texts: list[str], path: str, packed: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text as normalized, the counts of its prefixes, those of all texts one behind the
    other, and the offsets of the texts in them. A text has a place before its first
    character; special strings count at the place where they stand."""
    words = counter(path)
    parts: list[str] = []  # normalized stretches between special strings
    owner: list[int] = []  # text of each
    before: list[int] = []  # special strings of the text in front of it
    marks: list[tuple[int, int, int]] = []  # special strings so far behind so many parts of a text
    for row, text in enumerate(texts):
        special = 0
        for part in segments(text, words):
            if part is None:
                special += 1
                marks.append((row, len(parts), special))
            else:
                parts.append(normalized(part, words))
                owner.append(row)
                before.append(special)
    owner, before = np.array(owner, np.int64), np.array(before, np.int64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.searchsorted(owner, np.arange(len(texts) + 1))  # parts of each text
    ends = np.r_[0, np.cumsum(lengths)]
    starts = ends[rows] + np.arange(len(texts) + 1)  # places of each text
    found, first, stops = word_slices(parts, segment.unpacked_symbols(packed))
    inner = words.inner(found)
    counts = np.frombuffer(b"".join(inner), np.int32).astype(np.int64)
    widths = np.fromiter(map(len, inner), np.int64, len(inner)) // 4
    last = np.cumsum(widths)
    totals = np.r_[0, np.cumsum(counts[last - 1])]  # tokens before each word of the chunk
    per_part = np.diff(first)
    base = totals[:-1] - np.repeat(totals[first[rows]][owner], per_part) + np.repeat(before, per_part)
    stops = stops + np.repeat(ends[:-1] + owner + 1, per_part)
    places = np.arange(len(counts)) + np.repeat(stops - last, widths)
    out = np.zeros(int(starts[-1]), np.int64)
    filled = np.zeros(len(out), np.int64)
    out[places] = counts + np.repeat(base, widths)
    filled[places] = places
    filled[starts[:-1]] = starts[:-1]
    for row, done, special in marks:
        place = int(ends[done]) + row
        out[place] = totals[first[done]] - totals[first[rows[row]]] + special
        filled[place] = place
    out = out[np.maximum.accumulate(filled)]
    return ["".join(parts[a:b]) for a, b in zip(rows.tolist(), rows[1:].tolist())], out, starts


def count_rows(column: pa.Array, path: str, packed: bytes) -> list[pa.Array]:
    """Bytes and tokens of each text: the last of the counts of its prefixes."""
    _, ends = arrow.flat(column)
    _, counts, starts = prefix_counts(column.to_pylist(), path, packed)
    return [pa.array(np.diff(ends)), pa.array(counts[starts[1:] - 1])]


def token_counts(
    docs: DataFrame, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str = VOCABULARY,
) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row. Null and
    empty texts have no bytes and no tokens; repeated rows are counted each. A special string
    in a text counts as its one token. ``path``: the vocabulary, present on every executor."""
    fields, packed = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())], segment.packed_symbols("tokenizers")
    counted = arrow.map_texts(
        docs, [F.col(c) for c in keep], F.col(text), fields, lambda column: count_rows(column, path, packed)
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_rows(column: pa.Array, path: str, packed: bytes) -> list[pa.Array]:
    shown, counts, starts = prefix_counts(column.to_pylist(), path, packed)
    return [pa.array(shown, pa.string()), arrow.lists(starts, counts.astype(np.int32))]


def prefix_table(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``normalized``, the text as the vocabulary normalizes it (special strings taken out),
    and ``prefix_tokens array<int>``: at place k the tokens of its first k characters, as the
    library would count them. Place 0 counts special strings before any text."""
    fields = [StructField("normalized", StringType()), StructField("prefix_tokens", ArrayType(IntegerType()))]
    packed = segment.packed_symbols("tokenizers")
    return arrow.map_texts(docs, [F.col(c) for c in keep], F.col(text), fields, lambda column: prefix_rows(column, path, packed))


def longest_within(table: DataFrame, budget: int) -> DataFrame:
    """``table`` of :func:`prefix_table` with ``fit_chars``: how many leading characters take
    at most ``budget`` tokens. Counts of prefixes can fall by joining tokens, so the longest
    prefix that fits is asked for, not the first that does not. Nothing is encoded again."""
    places = F.sequence(F.lit(0), F.size("prefix_tokens") - 1)
    fits = F.filter(places, lambda k: F.get(F.col("prefix_tokens"), k) <= budget)
    return table.withColumn("fit_chars", F.array_max(fits))
