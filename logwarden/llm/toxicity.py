"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; all others, whatever their label, are
unlabelled. A linear model over word indicators minimises the risk estimator that corrects
for the toxic share hidden among the unlabelled: prior x risk of the positives as positive,
plus the unlabelled's risk as negative less prior x the positives' risk as negative, where
the second part is not allowed below zero: when it falls there, the step climbs back.
How common a word is among the unlabelled is counted over all rows that are not held out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from logwarden.llm import arrow, ngrams

BITS = 17
POSITIVE_ROWS, UNLABELLED_ROWS = 2_000, 4_000
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.9
STEPS, RATE, DECAY = 300, 0.05, 1e-3
FROM = 0.5
SURE = 4.5  # standard errors by which a slot must be more common among positives


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(ngrams.sums(ends, slots, self.weights) + self.bias, -30, 30)))


class Counts(NamedTuple):
    """Of a table the rows that have each slot, and all rows."""

    slots: np.ndarray
    rows: int


def slot_counts(docs: DataFrame, bits: int = BITS) -> Counts:
    """Counts over all texts. A task adds up what it reads; a row per slot reaches the driver,
    ``2 ** bits + 1`` at most."""
    schema = StructType([StructField("slot", LongType()), StructField("n", LongType())])

    def run(batches):
        total = np.zeros((1 << bits) + 1, np.int64)  # the last one counts rows
        for batch in batches:
            for chunk in arrow.chunks(batch.column(0)):
                total[:-1] += np.bincount(ngrams.word_grams(chunk, bits)[1], minlength=1 << bits)
                total[-1] += len(chunk)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=schema.names)

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return Counts(out[:-1], int(out[-1]))


def enrichment(positive: Counts, unlabelled: Counts) -> np.ndarray:
    """How much more often the positives have a slot than the unlabelled, as a log ratio.
    Slots seen in fewer than three positives, and ratios that chance explains, are 0."""
    p, u = positive.slots, unlabelled.slots
    ratio = np.log((p + 0.5) / (positive.rows + 1)) - np.log((u + 0.5) / (unlabelled.rows + 1))
    doubt = np.sqrt(1 / (p + 0.5) + 1 / (u + 0.5))
    return np.where((p >= 3) & (ratio > SURE * doubt), ratio, 0.0)


def risk(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The estimated risk of margins, and for each row the slope to go down. The loss of a row
    taken as negative is its chance, as positive one less its chance. While the unlabelled's
    part is below zero, the slope is the one on which that part climbs."""
    n, m = positive.sum(), (~positive).sum()
    chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    steep = chance * (1 - chance)
    as_negative = chance[~positive].mean() - prior * chance[positive].mean()
    value = prior * (1 - chance[positive]).mean() + max(as_negative, 0.0)
    if as_negative < 0:
        return value, np.where(positive, prior * steep / n, -steep / m)
    return value, np.where(positive, -2 * prior * steep / n, steep / m)


def one_of_each_family(ends: np.ndarray, slots: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies would make the words of one text look common among the toxic, and copies of
    toxic texts among the unlabelled would count against their words: one row of each
    family stays, a confirmed one if there is one."""
    first = ngrams.families(ends, slots)
    order = np.lexsort((np.arange(len(y)), -y, first))
    kept = np.sort(order[np.r_[True, first[order][1:] != first[order][:-1]]]) if len(y) else order
    parts = [slots[ends[k]:ends[k + 1]] for k in kept]
    return np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64), np.concatenate(parts) if parts else slots, y[kept]


def fit(ends: np.ndarray, slots: np.ndarray, y: np.ndarray, prior: float, size: int = 1 << BITS, unlabelled: Counts | None = None) -> Model:
    """``y``: 1 for a confirmed toxic row, 0 for an unlabelled one. ``unlabelled``: counts over
    all unlabelled rows, where those given are some of them. Without rows of both kinds there
    is nothing to tell apart, and every score is near 0."""
    ends, slots, y = one_of_each_family(ends, slots, y)
    positive = y == 1
    if len(y) == 0 or positive.all() or not positive.any():
        return Model(np.zeros(size), -10.0)
    kind = np.repeat(positive, np.diff(ends))
    confirmed = Counts(np.bincount(slots[kind], minlength=size).astype(float), int(positive.sum()))
    rest = unlabelled or Counts(np.bincount(slots[~kind], minlength=size).astype(float), int((~positive).sum()))
    scale = enrichment(confirmed, rest)
    used = np.flatnonzero(scale)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    inside = place[slots] >= 0
    row, column = row[inside], place[slots[inside]]
    x = scale[used][column]
    w, bias = np.full(len(used), 0.1), -2.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        _, slope = risk(np.bincount(row, w[column] * x, len(y)) + bias, positive, prior)
        gradient = np.r_[np.bincount(column, slope[row] * x, len(used)) + DECAY * w, slope.sum()]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0.0), bias - move[-1]
    weights = np.zeros(size)
    weights[used] = w * scale[used]
    return Model(weights, float(bias))


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(5)) == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Model:
    """Fitted on at most ``positives`` confirmed toxic documents and ``unlabelled`` others,
    both chosen by the hash of their ids and none of them held out; words are counted over
    all documents that are neither these positives nor held out. The class prior is the toxic
    share among the labels that are not held out."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1))
    count, toxic = usable.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / max(count, 1), LEAST_PRIOR), MOST_PRIOR)
    known = arrow.first_labels(labels, "toxic", ~held_out() & (F.col("toxic") == 1), positives)
    others = (
        docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("label", F.lit(0))
    )
    picked = known.union(others).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rest = docs.where(~held_out()).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
    return fit(*ngrams.gathered(sample, ngrams.word_grams, BITS, positives + unlabelled), prior, unlabelled=slot_counts(rest))


def score_rows(column: pa.Array, model: Model) -> np.ndarray:
    return model.score(*ngrams.word_grams(column, BITS))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row. A null text is an
    empty one, with the score of a text without any indicator; repeated rows are scored
    each; a row without an id is not held out."""
    found = arrow.map_texts(
        docs, [F.col("doc_id")], F.col("text"), [StructField("score", DoubleType())],
        lambda column: [pa.array(score_rows(column, model))],
    )
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= FROM).cast("int").alias("predicted"))
