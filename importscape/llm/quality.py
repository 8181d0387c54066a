"""Quality classifier: naive Bayes support vectors.

Features are hashed indicators of word n-grams (one and two words) and of n-grams of
word shapes (one to three: runs of letter cases, digits and marks, and whether the
word repeats the one before). Each indicator is scaled by its class log-count ratio;
a linear hinge-loss model is fitted on the scaled, length-normalised vectors by dual
coordinate descent; margins of a part that was not fitted give the calibration to
chances. Fitting uses at most ``labelled.SAMPLE_PER_CLASS`` rows of each class and
runs in the driver; scoring reads every whole text and keeps nothing.

Defined results: null and empty texts have no features and score the calibrated
chance at the intercept; without both classes among the labels every row scores the
share of label 1 (0.5 without labels); repeated rows score alike; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .hashing import buffers, mixed, span_hashes, spans

FEATURES = 1 << 18
#: Of byte values: 0 white space, 1 capital, 2 other letter or beyond ASCII, 3 digit, else the mark itself.
CLASSES = np.array([0 if c in b" \t\n\r\x0b\x0c" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the ascending indices of its features."""
    flags = np.zeros(FEATURES, bool)
    for _, data, places in buffers([(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]):
        raw = np.frombuffer(data, np.uint8)
        kind = CLASSES[raw]
        starts, ends = spans(kind > 0)
        words = span_hashes(LOWER[raw], starts, ends)
        first = np.flatnonzero((kind > 0) & (np.diff(kind, prepend=0) != 0))  # each run of a class within a word
        shapes = span_hashes(kind[first], np.searchsorted(first, starts), np.searchsorted(first, ends))
        repeated = np.diff(words, prepend=np.uint64(0)) == 0
        shapes = mixed(shapes + repeated.astype(np.uint64))
        grams = [words, words[:-1] * np.uint64(3) + words[1:], shapes + np.uint64(1), shapes[:-1] * np.uint64(5) + shapes[1:], shapes[:-2] * np.uint64(25) + shapes[1:-1] * np.uint64(5) + shapes[2:]]
        grams = [(mixed(g + np.uint64(k)) & np.uint64(FEATURES - 1)).astype(np.int64) for k, g in enumerate(grams)]
        cuts = np.searchsorted(starts, places)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for g, width in zip(grams, (1, 2, 1, 2, 3), strict=True):
                flags[g[a : max(a, b - width + 1)]] = True
            found = np.flatnonzero(flags)
            flags[found] = False
            yield found


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last is the intercept) of the L2-regularised hinge-loss model, by dual coordinate descent. y: -1 or 1."""
    w, alpha, rng = np.zeros(FEATURES + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norms = np.array([v @ v + 1 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


@dataclass
class Model:
    """weights: of each feature, its ratio included; squares: of the ratios; then intercept and calibration."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float
    a: float
    b: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(max(self.squares[r].sum(), 1e-12)) for r in rows], float) + self.intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return labelled.sigmoid(self.a * self.margins(features(texts)) + self.b)


def fit(rows: list[np.ndarray], y: np.ndarray, counts: dict[int, int], smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """rows: features of each sampled text, in an order that does not depend on the label. Every fifth row only calibrates."""
    total = sum(counts.values())
    if not (len(y) and (y == 0).any() and (y == 1).any()):
        share = min(max(counts.get(1, 0) / total, 0.01), 0.99) if total else 0.5
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    spare = np.arange(len(y)) % 5 == 4
    if min((y[spare] == 0).sum(), (y[spare] == 1).sum(), (y[~spare] == 0).sum(), (y[~spare] == 1).sum()) == 0:
        spare[:] = False
    own = np.flatnonzero(~spare)
    seen = [np.full(FEATURES, smoothing) for _ in range(2)]
    for i in own:
        seen[y[i]][rows[i]] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    values = [ratio[rows[i]] / max(np.sqrt((ratio[rows[i]] ** 2).sum()), 1e-6) for i in own]
    sign = np.where(y[own] == 1, 1.0, -1.0)
    balance = np.where(sign > 0, len(own) / (2 * (sign > 0).sum()), len(own) / (2 * (sign < 0).sum()))
    w = descend([rows[i] for i in own], values, sign, cost * balance)
    model = Model((ratio * w[:-1]).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), 1.0, 0.0)
    held = np.flatnonzero(spare) if spare.any() else own
    model.a, model.b = labelled.platt(model.margins([rows[i] for i in held]), y[held], labelled.class_weights(y[held], counts))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = labelled.SAMPLE_PER_CLASS) -> Model:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "y": batch.y, "f": [f.astype(np.int32).tobytes() for f in features(batch.text.tolist())]})

    chosen, counts = labelled.sample(docs, labels, label, per_class)
    got = chosen.mapInPandas(run, "doc_id long, y int, f binary").toPandas()  # 2 * per_class rows at most
    got = got.iloc[np.argsort([hash_order(int(d)) for d in got.doc_id], kind="stable")] if len(got) else got
    return fit([np.frombuffer(f, np.int32) for f in got.f], got.y.to_numpy(int), counts)


def hash_order(doc_id: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id), 17)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of FEATURES numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "score": shared.value.scores(batch.text.tolist())})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
