"""Bounded labelled samples, held-out rows, and calibration, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of each class that a model is fitted on, at most; taken in the order of a hash of the id.
SAMPLE_PER_CLASS = 2500
FOLDS = 5
#: Bytes of text that a model is fitted on, at most; a row over what is left of them is passed over.
FIT_BYTES = 48 << 20


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids never learned from; an id that is null is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = FIT_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text, lang) of at most per_class labelled, not held-out rows of each class and most_bytes of text, and the counts of the classes.

    Null labels and ids are no labels; repeated label rows count once, and an id
    with both labels counts for the larger.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(order).limit(per_class).union(known.where("y = 1").orderBy(order).limit(per_class))
    rows = stored(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id"))  # 2 * per_class rows at most
    sizes = rows.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy(order).collect()
    left, over = most_bytes, []
    for r in sizes:
        if r.n <= left:
            left -= r.n
        else:
            over.append(r.doc_id)
    return rows.where(~F.col("doc_id").isin(over)) if over else rows, counts


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) is the chance of label 1; Newton's method on weighted, smoothed targets."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * ab
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        ab = ab - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample drawn by class the shares of all labelled rows."""
    return np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y], float)
