"""Hashed n-gram indicators of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from logwarden.llm import arrow
from logwarden.llm.words import SPACE, words_of

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x09:0x0E] = SPACE
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_SHAPE = _LOWER.copy()
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def _slots(codes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    codes = (codes ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    codes ^= codes >> np.uint32(15)
    return ((codes * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)


def character_grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and sorted distinct slots: of every 4 bytes of the text in lower case,
    of every 4 bytes of its outline (kinds of letters, and marks as they are), and of runs
    of words that repeat the word before them. Each text is followed by white space of its
    own, and no gram reaches into the next text."""
    data, ends = arrow.flat(column)
    n, size = len(ends) - 1, 1 << bits
    gap = 4
    padded = np.full(len(data) + gap * n, SPACE, np.uint8)
    inside = np.ones(len(padded), bool)
    inside[(ends[1:, None] + gap * np.arange(n)[:, None] + np.arange(gap)).ravel()] = False
    owner = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(ends) + gap)[:max(len(padded) - 3, 0)]
    own = inside.copy()
    own[ends[1:] + gap * np.arange(n)] = True  # from a text's bytes and the first one behind it
    own = own[:len(owner)]
    owner = owner[own]
    found = np.zeros(n * size, bool)
    for salt, table in ((0x51ED, _LOWER), (0xA3C7, _SHAPE)):
        padded[inside] = table[data]
        wide = padded.astype(np.uint32)
        codes = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        found[owner + _slots(codes[own], salt, bits)] = True
    words = words_of(column, _LOWER)
    if len(words.hashes):
        same = np.r_[False, words.hashes[1:] == words.hashes[:-1]]
        same[words.rows[:-1][words.rows[:-1] < len(same)]] = False
        row = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(words.rows))
        for length in (1, 2, 3):  # so many repeats in a row
            run = same[length - 1:].copy()
            for k in range(1, length):
                run &= same[length - 1 - k:len(same) - k]
            hit = np.flatnonzero(run) + length - 1
            found[row[hit] + int(_slots(np.array([length], np.uint32), 0x77, bits)[0])] = True
    places = np.flatnonzero(found)
    return np.searchsorted(places, np.arange(n + 1) * size), places & (size - 1)


def word_grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and sorted distinct slots of the words in lower case and of their
    beginnings of 4, 5 and 6 bytes. A word is what lies between white space, without the
    ASCII marks around letters."""
    fold = _LOWER.copy()
    for byte in range(0x21, 0x7F):
        if not (0x30 <= byte < 0x3A or 0x41 <= byte < 0x5B or 0x61 <= byte < 0x7B):
            fold[byte] = SPACE
    words = words_of(column, fold)
    n = len(words.hashes)
    row = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(words.rows)) << bits
    mixed = (words.hashes ^ words.hashes >> np.uint64(32)).astype(np.uint32)
    parts = [row + _slots(mixed, 0x11, bits)]
    text = np.frombuffer(words.text + b" " * 8, np.uint8).astype(np.uint32)
    begin = words.places[:-1]
    lengths = np.diff(words.places) - 1
    code = np.zeros(n, np.uint32)
    for k in range(6):
        code = code * np.uint32(0x01000193) + text[begin + k] + np.uint32(1)
        if k >= 3:
            here = lengths > k
            parts.append(row[here] + _slots(code[here], 0x21 + k, bits))
    places = np.unique(np.concatenate(parts))
    return np.searchsorted(places, np.arange(len(column) + 1) << bits), places & ((1 << bits) - 1)


def sums(ends: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each row the sum of its slots' weights, added up from nothing: rounding does not
    depend on the rows before it."""
    total = np.zeros(len(ends) - 1)
    filled = np.flatnonzero(np.diff(ends))
    if len(filled):
        total[filled] = np.add.reduceat(weights[slots], ends[:-1][filled])
    return total


def families(ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Of each row the first row of its family: rows that agree in one of four bands of
    three least hashes, and in seven tenths of their slots, are taken for copies of each
    other. For samples, not for tables."""
    n = len(ends) - 1
    parent = list(range(n))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    filled = np.flatnonzero(np.diff(ends))
    if len(filled):
        least = [np.minimum.reduceat(_slots(slots.astype(np.uint32), 0x1F0 + k, 31), ends[:-1][filled]) for k in range(12)]
        for band in range(4):
            seen: dict = {}
            for row, key in zip(filled.tolist(), zip(*(m.tolist() for m in least[3 * band:3 * band + 3]))):
                other = seen.setdefault(key, row)
                a, b = sorted((top(other), top(row)))
                if a == b:
                    continue
                x, y = slots[ends[other]:ends[other + 1]], slots[ends[row]:ends[row + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 10 * common >= 7 * (len(x) + len(y) - common):
                    parent[b] = a
    return np.array([top(k) for k in range(n)], np.int64)


def gathered(sample: DataFrame, grams, bits: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, slots and labels of a bounded sample (doc_id, label, text), brought to the
    driver: a row takes at most ``2 ** bits / 8`` bytes, whatever its text. Of rows that
    repeat an id one is taken."""
    size = 1 << bits

    def work(column):
        ends, slots = grams(column, bits)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if 4 * (b - a) < size // 8:
                out.append(b"s" + slots[a:b].astype("<i4").tobytes())
            else:
                full = np.zeros(size, bool)
                full[slots[a:b]] = True
                out.append(b"b" + np.packbits(full).tobytes())
        return [pa.array(out, pa.binary())]

    found = arrow.map_texts(sample, [F.col("doc_id"), F.col("label")], F.col("text"), [StructField("slots", BinaryType())], work)
    once = found.groupBy("doc_id").agg(F.min(F.struct("slots", "label")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id")
    got = once.select("r.slots", "r.label").limit(rows).toPandas()
    parts = [
        np.frombuffer(x, "<i4", offset=1).astype(np.int64) if x[:1] == b"s" else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, offset=1)))
        for x in map(bytes, got["slots"])
    ]
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return ends, np.concatenate(parts) if parts else np.zeros(0, np.int64), got["label"].to_numpy(np.int64)
