"""Quality rules: gradient-boosted trees over statistics of a document.

The trees are grown on a bounded sample of labelled rows and flattened into arrays of
nodes, so a chunk of documents goes down all trees a level at a time. More repetition,
more symbols or more repeated lines can never make a document better: the trees are
monotone in those statistics.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField

from logwarden.llm import arrow
from logwarden.llm.words import SPACE, words_of

SAMPLE_ROWS = 10_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 60, 3, 0.2, 64, 5, 1.0
KEEP_FROM = 0.5

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x09:0x0E] = SPACE


def _kind(characters) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters)] = 1
    return table


_SYMBOLS = _kind(b"#*$%&|<>")
_POINTS = _kind(set(range(256)) - set(range(0x80, 0xC0)) - {0x20, *range(0x09, 0x0E)})
_UPPER, _DIGITS = _kind(range(0x41, 0x5B)), _kind(range(0x30, 0x3A))
_MARKS = _kind(b"!?.,;:'\"()[]{}-_/\\@^~`+=")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistics the trees look at, and whether the verdict may only fall as one grows (-1).
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1,
    "upper": 0, "digits": 0, "marks": 0, "doubled": -1, "line_words": 0, "distinct": 0,
}


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text and the matrix of its features."""
    data, ends = arrow.flat(column)
    raw = data.tobytes()
    words = words_of(column, FOLD)
    rows, n = words.rows, len(words.hashes)

    def per_row(table):
        return np.diff(np.r_[0, np.cumsum(table[data])][ends])

    mixed = np.zeros(max(n, 1), np.uint64)
    mixed[:n] = words.hashes
    window = np.zeros(max(n, 1), np.uint64)
    for k in range(min(3, n)):
        window[:n - k] = (window[:n - k] ^ window[:n - k] >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + mixed[k:n]
    doubled = np.r_[0, np.cumsum(np.r_[False, words.hashes[1:] == words.hashes[:-1]])] if n else np.zeros(1, np.int64)
    repeat, dup, lines, distinct, twice = (np.zeros(len(column), np.int64) for _ in range(5))
    for row, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
        if b > a:
            distinct[row] = len(np.unique(words.hashes[a:b]))
            twice[row] = doubled[b] - doubled[a + 1]
        if b - a >= 4:
            _, inverse, count = np.unique(window[a:b - 2], return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            hit = np.zeros(b - a, bool)
            for k in range(3):
                hit[k:b - a - 2 + k] |= again
            repeat[row] = hit.sum()
        filled = [line for line in raw[ends[row]:ends[row + 1]].split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        lines[row], dup[row] = len(filled), len(filled) - len(set(filled))
    n_words, chars, symbols = np.diff(rows), per_row(_POINTS), per_row(_SYMBOLS)
    counts = dict(zip(COUNTS, (n_words, chars, symbols, dup, repeat)))
    by_word, by_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    features = [
        np.log1p(n_words), chars / by_word, symbols / by_char, dup / np.maximum(lines, 1), repeat / by_word,
        per_row(_UPPER) / by_char, per_row(_DIGITS) / by_char, per_row(_MARKS) / by_char, twice / by_word,
        n_words / np.maximum(lines, 1), distinct / by_word,
    ]
    return counts, np.stack(features, 1).astype(np.float64)


class Forest(NamedTuple):
    """Nodes of all trees; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Forest:
    """Boost on log loss. Without rows of both labels the forest keeps everything."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []
    if len(y) == 0 or y.min() == y.max():
        start = 20.0 if len(y) == 0 or y[0] == 1 else -20.0
        return Forest(np.zeros(0, int), *(np.zeros(0) for _ in range(5)), start)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)

    def add(feature=0, threshold=np.inf, value=0.0):
        me = len(nodes["value"])
        for key, v in zip(nodes, (feature, threshold, me, me, value)):
            nodes[key].append(v)
        return me

    def build(rows, slope, curve, depth, low, high):
        g, h = slope[rows].sum(), curve[rows].sum()
        best = None
        if depth < DEPTH:
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                gl = np.cumsum(np.bincount(binned[rows, k], slope[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, k], curve[rows], size))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, k], minlength=size))[:-1]
                vl = np.clip(-gl / (hl + PENALTY), low, high)
                vr = np.clip(-(g - gl) / (h - hl + PENALTY), low, high)
                gain = -(gl * vl + (hl + PENALTY) * vl**2 / 2) - ((g - gl) * vr + (h - hl + PENALTY) * vr**2 / 2)
                fine = (nl >= LEAST_ROWS) & (len(rows) - nl >= LEAST_ROWS) & (monotone[k] * (vr - vl) >= 0)
                if fine.any():
                    gain = np.where(fine, gain, -np.inf)
                    p = int(gain.argmax())
                    if best is None or gain[p] > best[0]:
                        best = (gain[p], k, p, vl[p], vr[p])
        own = float(np.clip(-g / (h + PENALTY), low, high))
        if best is None or best[0] <= -(g * own + (h + PENALTY) * own**2 / 2) + 1e-9:
            margin[rows] += RATE * own
            return add(value=RATE * own)
        _, k, p, vl, vr = best
        me = add(k, float(cuts[k][p]))
        goes = binned[rows, k] <= p
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[monotone[k]]
        nodes["left"][me] = build(rows[goes], slope, curve, depth + 1, *bounds[0])
        nodes["right"][me] = build(rows[~goes], slope, curve, depth + 1, *bounds[1])
        return me

    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        roots.append(build(np.arange(len(y)), chance - y, chance * (1 - chance), 0, -np.inf, np.inf))
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Forest(np.array(roots), arrays["feature"], arrays["threshold"], arrays["left"], arrays["right"], arrays["value"], start)


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """The forest of at most ``rows`` labelled documents, chosen by the hash of their ids.
    What the driver gathers is a label and a row of numbers for each of them; of rows that
    repeat an id one is taken."""
    sample = arrow.labelled(docs, labels, "quality", F.lit(True), rows)
    width = len(FEATURES)

    def work(column):
        return [arrow.lists(np.arange(len(column) + 1) * width, statistics(column)[1].ravel())]

    found = arrow.map_texts(sample, [F.col("doc_id"), F.col("label")], F.col("text"), [StructField("x", ArrayType(DoubleType()))], work)
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).orderBy(F.xxhash64("doc_id")).select("r.x", "r.label").limit(rows).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, width)
    return grow(x, got["label"].to_numpy(np.float64), list(FEATURES.values()))


def verdicts(column: pa.Array, forest: Forest) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    counts, x = statistics(column)
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    score = forest.score(x)
    return counts, failed, score, ~failed & (score >= KEEP_FROM)


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` for every row. Null,
    empty and wordless texts have counts of zero and fail the base rules; repeated rows are
    judged each."""
    fields = [*(StructField(c, LongType()) for c in COUNTS), StructField("base_failed", BooleanType()),
              StructField("score", DoubleType()), StructField("kept", BooleanType())]

    def work(column):
        counts, failed, score, kept = verdicts(column, forest)
        return [*(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)]

    return arrow.map_texts(docs, [F.col("doc_id")], F.col("text"), fields, work)


def passing(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    return arrow.keep_rows(docs, "text", lambda column: verdicts(column, forest)[3])
