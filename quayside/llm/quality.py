"""Operator 5: quality classifier, a support vector machine on naive Bayes features.

Features are indicators of n-grams: three-byte windows of the raw text and patterns of repeated words,
hashed to ``DIMENSIONS``. Each indicator is scaled by the log ratio of its (smoothed) share of the good
and of the bad training documents; a linear model with hinge loss is fitted to the unit vectors by dual
coordinate descent. Margins become probabilities by a logistic curve.

The model is fitted on a sample of at most ``PER_CLASS`` labelled documents of each class, those with the
lowest hash of their id. Every document is scored, over its whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
PER_CLASS = 2000
PATTERNS = 64  # the last dimensions are for patterns of repeated words
CHUNK = 1 << 22


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct indices of a text's n-grams; none for a text of fewer than three bytes and no words."""
    raw = (text or "").encode("utf-8", "replace")
    seen = np.zeros(DIMENSIONS, bool)
    for at in range(0, len(raw), CHUNK):  # bounded temporary arrays for very long texts
        v = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(v) > 2:
            window = (v[:-2] | v[1:-1] << 8 | v[2:] << 16) * np.uint32(2654435761)
            seen[(window >> np.uint32(16)) % (DIMENSIONS - PATTERNS)] = True
    words = raw.split()
    for step in (1, 2, 3):
        if len(words) > step:
            same = sum(a == b for a, b in zip(words, words[step:], strict=False)) / (len(words) - step)
            seen[DIMENSIONS - PATTERNS + 16 * step + min(15, int(16 * same))] = True
    return np.flatnonzero(seen).astype("<i4")


@dataclass(frozen=True)
class Model:
    """``weights`` hold the log-count ratios already; ``ratios`` are needed for a text's length."""

    weights: np.ndarray
    ratios: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, index: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[index] ** 2).sum() + 1))
        margin = (float(self.weights[index].sum()) + self.intercept) / length
        return 1 / (1 + float(np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIMENSIONS), smoothing)
    for index, y in zip(rows, good, strict=True):
        counts[int(y), index] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    """Dual coordinate descent on the scaled indicators; the classes weigh the same.

    With one class only, every text gets that class with the share that smoothing leaves it; without
    any label every score is 0.5."""
    n, n_good = len(rows), int(good.sum())
    if n_good in (0, n):
        shift = float(np.log((n_good + 1) / (n - n_good + 1)))
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, shift)
    ratios = log_count_ratios(rows, good)
    y = np.where(good, 1.0, -1.0)
    bound = cost * n / (2 * np.where(good, n_good, n - n_good))
    vectors = []
    for index in rows:
        values = ratios[index]
        vectors.append(values / np.sqrt((values**2).sum() + 1))
    ones = [1 / np.sqrt((ratios[index] ** 2).sum() + 1) for index in rows]
    w, b, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            index, x, one = rows[i], vectors[i], ones[i]
            gradient = y[i] * (x @ w[index] + b * one) - 1
            new = min(max(alpha[i] - gradient, 0.0), bound[i])  # the vectors have length one
            step = (new - alpha[i]) * y[i]
            if step:
                w[index] += step * x
                b += step * one
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    margins = np.array([x @ w[index] + b * one for index, x, one in zip(rows, vectors, ones, strict=True)])
    slope, shift = _curve(margins, good)
    return Model(w * ratios, ratios, b, slope, shift)


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, the classes weighing the same; smoothed targets."""
    n_good = int(good.sum())
    n_bad = len(good) - n_good
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    weight = np.where(good, 0.5 / n_good, 0.5 / n_bad)
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * (theta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        theta -= change * min(1.0, 2.0 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def sample_labels(labels: DataFrame, label: str, per_class: int, where: F.Column) -> DataFrame:
    """``(doc_id, label)`` of at most ``per_class`` documents of each class 0 and 1, by lowest hash of the id.

    A document with contradicting labels or none of the two takes no part."""
    one = (
        labels.where(where & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
    )
    lowest = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return lowest[0].union(lowest[1])


def train(docs: DataFrame, labels: DataFrame, where: F.Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit to ``docs(doc_id, text)`` that ``labels(doc_id, quality)`` marks 0 or 1, where ``where`` holds.

    An id with several texts counts once, with the lowest of their feature sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([ngrams(x).tobytes() for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "label", "found"])

    chosen = sample_labels(labels, "quality", per_class, F.lit(True) if where is None else where)
    kind = dict(chosen.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int"), "text")
    rows = (
        texts.mapInArrow(run, f"doc_id {kind}, label int, found binary")
        .groupBy("doc_id", "label").agg(F.min("found").alias("found"))
        .orderBy("doc_id").collect()  # at most 2 * per_class rows of at most DIMENSIONS indices
    )
    return fit([np.frombuffer(r["found"], "<i4") for r in rows], np.array([r["label"] == 1 for r in rows], bool))


def score_column(model: Model):
    """A column function from a text to its score."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(ngrams(x)) for x in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs(doc_id, text)``: a row a row, ids or not.

    Null and empty texts have no n-grams and get the score of the intercept. Other columns are dropped."""
    scored = docs.select("doc_id", score_column(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
