"""Operator 2: toxicity by cumulative-link ordinal regression.

The model shares one weight vector across ordered thresholds: P(grade >= k) is the logistic function of
``w.x - threshold[k]``. Features are sparse: how often (log) each of a few thousand telling byte windows
of the lower-cased words occurs. They are chosen by a count over the training texts, as Spark rows.

``labels.toxic`` has two classes, so the severity grades are made from the training documents: 0 is not
toxic, and toxic ones get 1 to 3 by
terciles of how much their telling windows sum up to. Expected severity is the sum of
P(grade >= k); a document is toxic where P(grade >= 1) is at least one half.

Model and windows come from a sample of at most ``PER_CLASS`` labelled documents of each class. Every
document is scored, over its whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Store
from quayside.llm.quality import sample_labels

PER_CLASS = 3000
WIDTHS = (5, 6, 7)
FEATURES = 4096
EVIDENCE, LEAST_RATIO = 12, 3
GRADES = 3
CHUNK = 1 << 20
#: Bytes that end a word: ASCII but letters and digits. They become blanks, so windows see word ends.
_BLANKS = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256))


def windows(text: str | None) -> Iterator[np.ndarray]:
    """All byte windows of a text as 64-bit numbers (the window below its width), in bounded pieces."""
    words = (text or "").encode("utf-8", "replace").lower().translate(_BLANKS).split()
    raw = b" " + b" ".join(words) + b" " if words else b""
    for at in range(0, len(raw), CHUNK):
        v = np.frombuffer(raw[at : at + CHUNK + max(WIDTHS) - 1], np.uint8).astype(np.uint64)
        for width in WIDTHS:
            n = min(CHUNK, len(v) - width + 1)
            if n > 0:
                packed = np.zeros(n, np.uint64)
                for k in range(width):
                    packed = packed << np.uint64(8) | v[k : k + n]
                yield packed | np.uint64(width << 56)


@dataclass(frozen=True)
class Model:
    windows: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        gate = np.zeros(1 << 16, bool)
        gate[_gate(self.windows)] = True
        object.__setattr__(self, "gate", gate)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the model's windows in a text, and how often each occurs."""
        found = []
        for packed in windows(text):
            packed = packed[self.gate[_gate(packed)]]
            if len(packed):
                at = np.minimum(np.searchsorted(self.windows, packed), len(self.windows) - 1)
                found.append(at[self.windows[at] == packed])
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2

    def reached(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        if not len(self.windows):
            return np.zeros(len(self.thresholds))
        index, n = self.counts(text)
        return _logistic(float(self.weights[index] @ np.log1p(n)) - self.thresholds)


def _gate(packed: np.ndarray) -> np.ndarray:
    return (packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, features: int, penalty: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights (not negative) and ordered thresholds of the cumulative-link model, by adaptive gradient steps.

    Classes weigh the same: toxic and other documents by half each."""
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.log1p(np.concatenate([n for _, n in rows])) if rows else np.zeros(0)
    share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    top = int(grades.max())
    # thresholds = first, then first plus positive gaps: they stay in order
    w, base, gaps = np.full(features, 0.1), 1.0, np.zeros(top - 1)
    moments = [[np.zeros_like(np.atleast_1d(x), float)] * 2 for x in (w, base, gaps)]
    for t in range(1, steps + 1):
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        margin = np.bincount(owner, value * w[index], len(rows))
        p = _logistic(margin[:, None] - thresholds)
        # P(grade = y) is a difference of neighbours; its log-likelihood has this gradient in margin and thresholds
        upper = np.concatenate([np.ones((len(rows), 1)), p], axis=1)[np.arange(len(rows)), grades]
        lower = np.concatenate([p, np.zeros((len(rows), 1))], axis=1)[np.arange(len(rows)), grades]
        chance = np.maximum(upper - lower, 1e-9)
        by_upper, by_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_margin = -share * (by_upper - by_lower)
        d_threshold = np.zeros(top)
        for k in range(top):
            d_threshold[k] = (share * by_upper)[grades == k + 1].sum() - (share * by_lower)[grades == k].sum()
        gradients = [
            np.bincount(index, value * d_margin[owner], features) + penalty * w,
            np.array([d_threshold.sum()]),
            np.array([d_threshold[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)]),
        ]
        new = []
        for k, (x, g) in enumerate(zip((w, base, gaps), gradients, strict=True)):
            moments[k] = [0.9 * moments[k][0] + 0.1 * g, 0.99 * moments[k][1] + 0.01 * g * g]
            step = 0.05 * (moments[k][0] / (1 - 0.9**t)) / (np.sqrt(moments[k][1] / (1 - 0.99**t)) + 1e-8)
            new.append(x - step)
        w, base, gaps = np.maximum(new[0], 0), float(new[1][0]), new[2]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def telling_windows(texts: DataFrame, features: int) -> list[int]:
    """The windows that mark toxic texts best, from ``texts(label, text)``: by documents of each class that
    hold them (a count over all rows). So many windows are tried that chance alone would give some; only those
    whose counts chance explains too badly (``EVIDENCE``) are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = list(windows(text))
                if held:
                    held = np.unique(np.concatenate(held)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), label, np.int32))], ["held", "label"])

    total = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    share = (total.get(1, 0) + 0.5) / (total.get(0, 0) + total.get(1, 0) + 1)
    toxic, clean = F.col("toxic"), F.col("clean")
    held = toxic + clean
    # How much likelier these counts are than at the share of toxic texts, as a log ratio.
    gain = toxic * F.log(toxic / (held * share)) + F.when(clean > 0, clean * F.log(clean / (held * (1 - share)))).otherwise(0.0)
    ratio = F.log((toxic + 0.5) / (total.get(1, 0) + 1)) - F.log((clean + 0.5) / (total.get(0, 0) + 1))
    rows = (
        texts.select("label", "text").mapInArrow(run, "held long, label int")
        .groupBy("held").agg(F.sum("label").alias("toxic"), (F.count("*") - F.sum("label")).alias("clean"))
        .where((toxic > 0) & (ratio > LEAST_RATIO)).withColumn("_gain", gain).where(F.col("_gain") > EVIDENCE)
        .orderBy(F.desc("_gain"), "held").limit(features).select("held").collect()
    )
    return [r["held"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, store: Store, where: F.Column | None = None, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """Fit to ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks 0 or 1, where ``where`` holds.

    Equal texts count once, so a group of copies doesn't pass for evidence. Without toxic labels, or
    windows that tell them, the model finds nothing toxic."""
    chosen = sample_labels(labels, "toxic", per_class, F.lit(True) if where is None else where)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy(F.sha2("text", 256).alias("_key")).agg(F.min("label").cast("int").alias("label"), F.min("text").alias("text")).select("label", "text")
    texts = store.keep(texts, "sample")
    found = np.sort(np.array(telling_windows(texts, features), np.int64).view(np.uint64))
    empty = Model(found, np.zeros(len(found)), np.arange(1.0, GRADES + 1))
    if not len(found):
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [empty.counts(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k].astype("<i4").tobytes() for r in rows], pa.binary()) for k in (0, 1)]], ["label", "index", "n"]
            )

    # At most two small arrays for each of 2 * per_class documents.
    rows = texts.mapInArrow(run, "label int, index binary, n binary").orderBy("label", "index", "n").collect()
    counts = [(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows]
    toxic = np.array([r["label"] == 1 for r in rows], bool)
    amount = np.array([np.log1p(n).sum() for _, n in counts])
    if not toxic.any() or toxic.all():
        return empty
    cuts = np.quantile(amount[toxic], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(toxic, 1 + np.searchsorted(cuts, amount, side="right"), 0)
    return Model(found, *fit_ordinal(counts, grades, len(found)))


def severity_column(model: Model):
    """A column function from a text to ``struct(severity, chance)``: expected grade and P(grade >= 1)."""
    @F.pandas_udf("severity double, chance double")
    def severity(texts: pd.Series) -> pd.DataFrame:
        reached = [model.reached(x) for x in texts]
        return pd.DataFrame({"severity": [float(x.sum()) for x in reached], "chance": [float(x[0]) for x in reached]})

    return severity


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, chance, toxic`` of every row of ``docs(doc_id, text)``: a row a row, ids or not.

    ``severity`` is from 0 to 3, ``toxic`` whether ``chance`` is at least one half. Null and empty texts
    hold no window and have the severity of the thresholds alone. Other columns are dropped."""
    scored = docs.select("doc_id", severity_column(model)("text").alias("_s"))
    return scored.select("doc_id", "_s.severity", "_s.chance", (F.col("_s.chance") >= 0.5).alias("toxic"))
