"""Toxicity by cumulative-link ordinal regression: one weight vector over sparse word features, one threshold per grade."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import byte_slices, table, trimmed, word_spans, Hasher

SCORES = "doc_id long, severity double, grade int, toxic boolean"


class Ordinal(NamedTuple):
    """P(grade <= k) = sigmoid(theta[k] - score), score = sum of the weights of the distinct features of a text."""

    weights: np.ndarray
    theta: np.ndarray


def _features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every word, A-Z lower-cased and stripped of ASCII punctuation at its ends, hashed."""
    starts, ends, counts = word_spans(buf, offs)
    starts, ends = trimmed(buf, starts, ends)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(counts))
    return owner, (Hasher(buf, lower=True).of(starts, ends) % np.uint64(buckets)).astype(np.int64)


def labelled_features(docs: DataFrame, labels: DataFrame, buckets: int, max_rows: int) -> list[tuple[int, np.ndarray]]:
    """(label, distinct features) of at most `max_rows` labelled texts: those whose doc_id has the smallest hash."""
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id").select("_toxic", "text")

    def extract(batches):
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for first, _, buf, offs in byte_slices(batch, "text"):
                owner, feature = _features(buf, offs, buckets)
                cuts = np.searchsorted(owner, np.arange(1, len(offs) - 1))
                rows = [np.unique(x).astype(np.int32) for x in np.split(feature, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[first : first + len(rows)], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "x"])

    return [(r["y"], np.frombuffer(r["x"], np.int32)) for r in rows.mapInArrow(extract, "y int, x binary").collect()]


def fit(rows: list[tuple[int, np.ndarray]], buckets: int, min_z: float, epochs: int, l2: float) -> Ordinal:
    """Weights for the words whose document rates differ by at least `min_z` standard errors between toxic and clean texts.

    The labels are the grades: 0 is clean, each step above it more severe. A table of 0 and 1 has one threshold; with more
    grades all thresholds share the weights."""
    if not rows or len({min(y, 1) for y, _ in rows}) < 2:
        rate = float(np.mean([y for y, _ in rows])) if rows else 0.0
        return Ordinal(np.zeros(buckets), np.array([-20.0 if rate > 0.5 else 20.0]))
    y = np.array([max(t, 0) for t, _ in rows])
    bad = y > 0
    seen = np.zeros((2, buckets))
    for t, x in rows:
        seen[int(t > 0), x] += 1
    n = np.array([(~bad).sum(), bad.sum()], float)
    p = seen.sum(0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.nan_to_num((seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])))
    kept = np.flatnonzero((np.abs(z) >= min_z) & (seen.sum(0) >= 5))
    slot = np.full(buckets, -1)
    slot[kept] = np.arange(len(kept))
    # the texts are sparse: (text, kept feature) pairs in place of a matrix
    row = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    column = slot[np.concatenate([f for _, f in rows])]
    row, column = row[column >= 0], column[column >= 0]
    top = int(y.max())
    w, theta = np.zeros(len(kept)), np.linspace(0.5, 1.5, top)
    step_w, step_t = np.full(len(kept), 1e-8), np.full(top, 1e-8)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for _ in range(epochs):
        s = np.bincount(row, w[column], len(y))
        cuts = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(cuts[y + 1] - s), sigmoid(cuts[y] - s)
        upper[y == top], lower[y == 0] = 1, 0
        gap = np.maximum(upper - lower, 1e-9)
        g = np.bincount(column, (1 - upper - lower)[row], len(w)) / len(y) + l2 * w
        du, dl = upper * (1 - upper) / gap, lower * (1 - lower) / gap
        gt = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(y) for k in range(top)])
        step_w += g * g
        step_t += gt * gt
        w -= 0.5 * g / np.sqrt(step_w)
        theta = np.maximum.accumulate(theta - 0.5 * gt / np.sqrt(step_t) + np.arange(top) * 1e-6)
    weights = np.zeros(buckets)
    weights[kept] = w
    return Ordinal(weights, theta)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 18,
    max_rows: int = 8_000,
    min_z: float = 4.5,
    threshold: float = 0.5,
    epochs: int = 3_000,
    l2: float = 1e-4,
) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (most likely one), toxic (severity >= threshold).

    Null and empty texts have no feature: their severity is that of a text without marks. Repeated rows are scored each.
    Grades that are equally likely: the lower one. Of several labels of a doc_id the highest counts, negative ones are 0.
    Without labels of both kinds no weight is learned. An empty table of documents gives no rows. Only doc_id, text and toxic
    are read, so other columns may have any name. A very long text costs memory in proportion to its words. The model is fitted on at most `max_rows` labelled texts; all texts
    are scored in one pass without a shuffle, and only `buckets` weights travel to the tasks."""
    model = fit(labelled_features(docs, labels, buckets, max_rows), buckets, min_z, epochs, l2)
    marked = np.flatnonzero(model.weights)
    values, theta = model.weights[marked], model.theta

    def score(batches):
        weights = np.zeros(buckets)
        weights[marked] = values
        for batch in batches:
            for first, end, buf, offs in byte_slices(batch, "text"):
                owner, feature = _features(buf, offs, buckets)
                hit = weights[feature] != 0
                pairs = np.unique(owner[hit] * buckets + feature[hit])
                s = np.bincount(pairs // buckets, weights[pairs % buckets], end - first)
                over = 1 - 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -40, 40)))
                p = -np.diff(np.concatenate([np.ones((len(s), 1)), over, np.zeros((len(s), 1))], axis=1), axis=1)
                severity = over.sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(severity), pa.array(p.argmax(1), pa.int32()), pa.array(severity >= threshold)], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORES)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
