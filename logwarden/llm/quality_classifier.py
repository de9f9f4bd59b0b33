"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their counts in the two classes; a linear
model with hinge loss is fitted to the scaled indicators by dual coordinate descent, and a
logistic curve on left-out margins turns its margin into a chance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from logwarden.llm import arrow, ngrams

BITS = 15
SAMPLE_ROWS = 4_000
COST, EPOCHS = 1.0, 20
KEEP_FROM = 0.7


class Model(NamedTuple):
    weights: np.ndarray  # of slots
    bias: float
    slope: float
    offset: float

    def score(self, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        margin = ngrams.sums(ends, slots, self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_ratios(ends: np.ndarray, slots: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    counts = [1 + np.bincount(slots[y[row] == k], minlength=size) for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(ends: np.ndarray, slots: np.ndarray, y: np.ndarray, scale: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss over ``rows``: weights of
    slots and the bias, which is one more coordinate. A row without indicators gets the
    bias alone, so it leans to the more common label."""
    w, bias = np.zeros(len(scale)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(y))
    xs = {int(i): slots[ends[i]:ends[i + 1]] for i in rows}
    square = {i: float((scale[s] ** 2).sum()) + 1.0 for i, s in xs.items()}
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(rows).tolist():
            s = xs[i]
            x = scale[s]
            slope = sign[i] * (float(w[s] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), COST)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[s] += step * x
                bias += step
                moved = max(moved, abs(step) * square[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * scale, bias


def curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through left-out margins, by Newton steps on
    softened labels."""
    up, down = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    unit = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / unit, np.ones(len(y))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * (b - [1, 0])), -2, 2)
    return float(max(b[0], 1e-3) / unit), float(b[1])


def fit(ends: np.ndarray, slots: np.ndarray, y: np.ndarray, size: int = 1 << BITS) -> Model:
    """Without rows of both labels the score is constant: that of the label there is, and 1
    without any, as nothing has been learned against a document."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(size), 0.0, 1.0, 30.0 if len(y) == 0 or y[0] == 1 else -30.0)
    scale = log_ratios(ends, slots, y, size)
    margin = np.zeros(len(y))
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        mine = np.flatnonzero(y == k)
        fold[mine] = np.arange(len(mine)) % 3
    for k in range(3):
        rest = np.flatnonzero(fold != k)
        part_ends = np.r_[0, np.cumsum(np.diff(ends)[rest])]
        part_slots = np.concatenate([slots[ends[i]:ends[i + 1]] for i in rest]) if len(rest) else slots[:0]
        own = log_ratios(part_ends, part_slots, y[rest], size)
        w, bias = descend(ends, slots, y, own, rest)
        margin[fold == k] = (ngrams.sums(ends, slots, w) + bias)[fold == k]
    return Model(*descend(ends, slots, y, scale, np.arange(len(y))), *curve(margin, y))


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents that are not held out."""
    sample = arrow.labelled(docs, labels, "quality", ~held_out(), rows)
    return fit(*ngrams.gathered(sample, ngrams.character_grams, BITS, rows))


def score_rows(column: pa.Array, model: Model) -> np.ndarray:
    return model.score(*ngrams.character_grams(column, BITS))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row. A null text is an
    empty one, scored by its (few) indicators like any other; repeated rows are scored each;
    a row without an id is not held out."""
    found = arrow.map_texts(
        docs, [F.col("doc_id")], F.col("text"), [StructField("score", DoubleType())],
        lambda column: [pa.array(score_rows(column, model))],
    )
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def passing(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    return arrow.keep_rows(docs, "text", lambda column: score_rows(column, model) >= KEEP_FROM)
