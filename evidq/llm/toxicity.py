"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

The labels say toxic or not. Severities come from them in two steps: features that are far more frequent in toxic texts
are found by how far their count in toxic texts is from chance, and toxic texts are graded 1 to 3 by how many distinct
ones they hold, cut at thirds of the sample; texts labelled clean are grade 0. The model then has one weight per telling
feature, shared by ordered thresholds t_1 < t_2 < t_3, with P(grade >= k) = sigmoid(score - t_k), fitted by proximal
gradient steps with an L1 penalty. Features are the distinct words of a text, hashed, so long texts score no higher for
being long, and texts with the same features count once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import non_empty

BITS = 18
GRADES = 3
_SCHEMA = "expected_severity double, p_toxic double, grade int"


def features(text: Column) -> Column:
    """Sorted hashed distinct words: runs of letters and digits in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << BITS)).cast("int")))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, least: float = 5.0, odds: float = 3.0) -> np.ndarray:
    """Of each feature, whether its count in toxic texts is ``least`` standard deviations above chance.

    Its log odds must be over ``odds`` too, and it must stand in three toxic texts.
    """
    count, bad = np.bincount(cols, minlength=1 << BITS), np.bincount(cols[toxic[rows] > 0], minlength=1 << BITS)
    n, share = len(toxic), toxic.mean() if len(toxic) else 0.0
    far = bad - share * count > least * np.sqrt(share * (1 - share) * count)
    ratio = np.log((bad + 0.5) / (n * share + 1)) - np.log((count - bad + 0.5) / (n * (1 - share) + 1))
    return (bad >= 3) & far & (ratio > odds)


def grade(held: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of a labelled sample from the number of telling features that each text holds."""
    cuts = np.quantile(held[toxic > 0], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    return np.where(toxic > 0, 1 + (held[:, None] > cuts[None, :]).sum(1), 0)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, l1: float = 1e-2, steps: int = 600) -> Model:
    """Weights and ordered thresholds that fit the grades of texts given as feature coordinates."""
    used, at = np.unique(cols, return_inverse=True)
    n, k = len(grades), GRADES
    w, t = np.zeros(len(used)), np.arange(k) * 1.0
    m = v = np.zeros(len(used) + k)
    for turn in range(1, steps + 1):
        p = np.hstack([np.ones((n, 1)), _sigmoid(np.bincount(rows, w[at], n)[:, None] - t[None, :]), np.zeros((n, 1))])
        i = np.arange(n)
        high, low = p[i, grades], p[i, grades + 1]
        # d log(high - low): through P(>= grade), and P(>= grade + 1)
        gap = np.maximum(high - low, 1e-9)
        dh, dl = -high * (1 - high) / gap / n, low * (1 - low) / gap / n
        g = np.bincount(at, (dh + dl)[rows], len(used))
        gt = -np.array([dh[grades == j].sum() + dl[grades == j - 1].sum() for j in range(1, k + 1)])
        g = np.concatenate([g, gt])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * min(1.0, 4 * (1 - turn / (steps + 1)))
        move = step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        w, t = w - move[: len(used)], np.sort(t - move[len(used) :])
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        t = np.maximum.accumulate(t + np.arange(k) * 1e-6)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fit on at most ``sample`` labelled documents, half of them toxic if there are as many, by a hash of their ids."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.where(f).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for f in ("toxic > 0", "toxic <= 0")]
    picks = F.broadcast(picks[0].union(picks[1]))  # ``sample`` rows at most
    rows = docs.where("doc_id IS NOT NULL").join(picks, "doc_id").select("doc_id", "toxic", features(non_empty("text")).alias("f"))
    rows = rows.groupBy(F.xxhash64("f").alias("h")).agg(F.max_by(F.struct("toxic", "f"), F.struct("toxic", "doc_id")).alias("one"))
    rows = rows.orderBy("h").limit(sample).select("one.toxic", "one.f").toArrow()
    toxic, lists = (rows.column("toxic").to_numpy() > 0).astype(np.int64), rows.column("f").combine_chunks()
    cols = lists.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy().astype(np.int64))
    keep = telling(at, cols, toxic)[cols]
    return fit(at[keep], cols[keep], grade(np.bincount(at[keep], minlength=len(toxic)), toxic))


def _scored(held):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in it:
            lists = batch.column("f")
            n = lists.value_lengths().to_numpy().astype(np.int64)
            at = np.repeat(np.arange(len(n)), n)
            p = model.at_least(np.bincount(at, model.weights[lists.flatten().to_numpy()], len(n)))
            new = [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p > 0.5).sum(1).astype(np.int32))]
            rest = [c for c in batch.schema.names if c != "f"]
            yield pa.record_batch([*(batch.column(c) for c in rest), *new], [*rest, "expected_severity", "p_toxic", "grade"])

    return batches


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade and rejected for every row of ``docs`` (doc_id, text).

    expected_severity is the sum of P(grade >= k), p_toxic is P(grade >= 1), grade the largest k with P(grade >= k) over
    a half; texts of grade 1 or more are rejected. A null or empty text has no features and gets the base rate of none.
    Null doc_ids stay, rows that repeat are scored each, other columns are ignored, an empty table gives no rows. The
    model has a fixed size of 2^18 weights, which bounds the broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", features(non_empty("text")).alias("f"))
    out = rows.mapInArrow(_scored(held), f"doc_id long, {_SCHEMA}")
    return out.withColumn("rejected", F.col("grade") >= 1)


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"), features(non_empty("text")).alias("f"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_scored(held), f"row {kind}, {_SCHEMA}")
    return out.where("grade < 1").select("row.*")
