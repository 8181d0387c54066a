"""Toxicity: a convolutional text classifier with hashed word embeddings, in numpy.

Words (runs of letters and digits, lower case) and their beginnings are hashed into
embedding rows; a word's embedding is the sum of its rows, so that unseen forms of a
known stem are known too. Filters of one, two and three words run over the whole
text; each keeps its maximum, and a logistic layer weighs the maxima. The first component of an
embedding starts at the smoothed class log-count ratio of its row, the others at
small random numbers; all are trained with Adagrad, through the maxima only.

Rows that were not fitted give the calibration to chances and, for each language
with enough of them, the threshold with the best F1; other languages take the
threshold over all. Languages choose thresholds only and never enter a score.

Fitting uses at most ``labelled.SAMPLE_PER_CLASS`` rows of each class and runs in
the driver; scoring reads every whole text in buffers and keeps nothing.

Defined results: null and empty texts have no words and score as such; without both
classes among the labels every row scores the share of label 1 (0.5 without
labels); repeated rows score alike; a null language takes the threshold over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import tidy
from .hashing import buffers, mixed, span_hashes, spans
from .quality import hash_order

ROWS, WIDTH, FILTERS, SIZES = 1 << 18, 8, 8, (1, 2, 3)
#: Texts that a worker makes strings at once.
SLICE = 500
#: Bytes of a word's beginnings that have rows of their own.
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)
#: Spare rows of a language, of each class, from which it gets a threshold of its own.
LEAST_SPARE = 15
WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def word_rows(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the embedding rows of its words, in order: (words, PARTS), ROWS where a word is too short."""
    for _, data, places in buffers([(t if isinstance(t, str) else "").lower().encode("utf-8", "surrogatepass") for t in texts]):
        raw = np.frombuffer(data, np.uint8)
        starts, ends = spans(WORD[raw])
        rows = np.full((len(starts), PARTS), ROWS, np.int32)
        rows[:, 0] = span_hashes(raw, starts, ends) & np.uint64(ROWS - 1)
        for k, n in enumerate(PREFIXES, 1):
            long = np.flatnonzero(ends - starts > n)
            rows[long, k] = mixed(span_hashes(raw, starts[long], starts[long] + n) + np.uint64(n)) & np.uint64(ROWS - 1)
        cuts = np.searchsorted(starts, places)
        yield from (rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def padding(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.full((SIZES[-1], PARTS), ROWS, words.dtype)])


@dataclass
class Model:
    """embedding: (ROWS + 1, WIDTH), the last row is padding; filters: of each size (size * WIDTH, FILTERS)."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    out: np.ndarray
    intercept: float = 0.0
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """The maxima of all filters over a text, and where they are; long texts in overlapping blocks."""
        padded = padding(words)
        best, place = [], []
        for size, f, o in zip(SIZES, self.filters, self.offsets, strict=True):
            most, where = np.full(FILTERS, -np.inf), np.zeros(FILTERS, np.int64)
            for at in range(0, max(len(words), 1), block):
                e = self.embedding[padded[at : at + block + size - 1]].sum(1)
                n = max(min(len(words) - at, block), 1)
                z = sum(e[k : k + n] @ f[k * WIDTH : (k + 1) * WIDTH] for k in range(size))
                p = z.argmax(0)
                v = z[p, np.arange(FILTERS)]
                better = v > most
                most[better], where[better] = v[better], at + p[better]
            best.append(np.maximum(most + o, 0))
            place.append(where)
        return np.concatenate(best), np.concatenate(place)

    def margins(self, texts: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.pooled(w)[0] @ self.out for w in texts], float) + self.intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return labelled.sigmoid(self.a * self.margins(word_rows(texts)) + self.b)


def blank() -> Model:
    return Model(np.zeros((ROWS + 1, WIDTH), np.float32), [np.zeros((s * WIDTH, FILTERS), np.float32) for s in SIZES], [np.zeros(FILTERS, np.float32) for _ in SIZES], np.zeros(FILTERS * len(SIZES), np.float32))


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, near: float = 0.995) -> float:
    """Of the thresholds whose weighted F1 is within ``near`` of the best, the one closest to 0.5; 0.5 if there is no choice."""
    order = np.argsort(-scores, kind="stable")
    s, hits, all_ = scores[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    if not len(s) or not y.any():
        return 0.5
    f1 = 2 * hits / (all_ + (weight * y).sum())
    last = np.append(s[1:] != s[:-1], True)
    good = np.flatnonzero(last & (f1 >= near * f1[last].max()))
    low = (s[good] + np.append(s[1:], 0.0)[good]) / 2  # a threshold may lie from there up to s
    closest = np.clip(0.5, low, s[good])
    return float(closest[np.abs(closest - 0.5).argmin()])


def fit(rows: list[np.ndarray], y: np.ndarray, langs: list[str | None], counts: dict[int, int], rounds: int = 6, rate: float = 0.05, seed: int = 3) -> Model:
    """rows: word rows of each sampled text, in an order that does not depend on the label. Every fourth row only calibrates."""
    model, total = blank(), sum(counts.values())
    if not (len(y) and (y == 0).any() and (y == 1).any()):
        share = min(max(counts.get(1, 0) / total, 0.01), 0.99) if total else 0.5
        model.b = float(np.log(share / (1 - share)))
        return model
    spare = np.arange(len(y)) % 4 == 3
    if min((y[spare] == 0).sum(), (y[spare] == 1).sum(), (y[~spare] == 0).sum(), (y[~spare] == 1).sum()) == 0:
        spare[:] = False
    own, rng = np.flatnonzero(~spare), np.random.default_rng(seed)
    seen = [np.ones(ROWS + 1) for _ in range(2)]
    for i in own:
        seen[y[i]][np.unique(rows[i])] += 1
    n = [(y[own] == k).sum() + 2 for k in range(2)]
    model.embedding[:] = rng.normal(0, 0.05, model.embedding.shape)
    model.embedding[:, 0] = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    model.embedding[ROWS] = 0
    for f in model.filters:
        f[:] = rng.normal(0, 0.2, f.shape)
        f[::WIDTH] = np.abs(f[::WIDTH]) + 0.2
    model.out[:] = rng.normal(0, 0.1, len(model.out)) + 0.1
    weight = np.where(y == 1, 1 / max((y[own] == 1).sum(), 1), 1 / max((y[own] == 0).sum(), 1)) * len(own) / 2
    history = {name: 1e-2 for name in ("out", "intercept")} | {("f", k): 1e-2 for k in range(len(SIZES))} | {("o", k): 1e-2 for k in range(len(SIZES))}
    row_history = np.full(ROWS + 1, 1e-2)

    def moved(name, gradient):
        history[name] = history[name] + gradient * gradient
        return rate * gradient / np.sqrt(history[name])

    for _ in range(rounds):
        for i in rng.permutation(own):
            maxima, place = model.pooled(rows[i])
            error = weight[i] * (labelled.sigmoid(maxima @ model.out + model.intercept) - y[i])
            if abs(error) < 1e-3:
                continue
            back = np.where(maxima > 0, error * model.out, 0)
            model.out -= moved("out", error * maxima).astype(np.float32)
            model.intercept -= float(moved("intercept", error))
            padded = padding(rows[i])
            for k, size in enumerate(SIZES):
                g, p = back[k * FILTERS : (k + 1) * FILTERS], place[k * FILTERS : (k + 1) * FILTERS]
                words = padded[p[:, None] + np.arange(size)]  # filter x size x part
                e = model.embedding[words].sum(2).reshape(FILTERS, -1)
                to_words = np.repeat((g[:, None] * model.filters[k].T).reshape(-1, WIDTH), PARTS, axis=0)
                model.filters[k] -= moved(("f", k), (g[:, None] * e).T).astype(np.float32)
                model.offsets[k] -= moved(("o", k), g).astype(np.float32)
                flat = words.ravel()
                np.add.at(row_history, flat, (to_words**2).mean(1))
                np.add.at(model.embedding, flat, (-rate * to_words / np.sqrt(row_history[flat])[:, None]).astype(np.float32))
                model.embedding[ROWS] = 0
    held = np.flatnonzero(spare) if spare.any() else own
    margins, share = model.margins(rows[i] for i in held), labelled.class_weights(y[held], counts)
    model.a, model.b = labelled.platt(margins, y[held], share)
    scores = labelled.sigmoid(model.a * margins + model.b)
    model.threshold = best_threshold(scores, y[held], share)
    spoken = np.array([langs[i] or "" for i in held])
    for lang in set(spoken) - {""}:
        its = spoken == lang
        if min((y[held][its] == 0).sum(), (y[held][its] == 1).sum()) >= LEAST_SPARE:
            model.thresholds[str(lang)] = best_threshold(scores[its], y[held][its], share[its])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = labelled.SAMPLE_PER_CLASS) -> Model:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "y": batch.y, "lang": batch.lang, "f": [f.tobytes() for f in word_rows(batch.text.tolist())]})

    chosen, counts = labelled.sample(docs, labels, label, per_class)
    got = chosen.mapInPandas(run, "doc_id long, y int, lang string, f binary").toPandas()  # 2 * per_class rows at most
    got = got.iloc[np.argsort([hash_order(int(d)) for d in got.doc_id], kind="stable")] if len(got) else got
    return fit([np.frombuffer(f, np.int32).reshape(-1, PARTS) for f in got.f], got.y.to_numpy(int), [x if isinstance(x, str) else None for x in got.lang], counts)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, and toxic: whether the score reaches its language's threshold. Columns of those names are replaced."""
    docs = docs.drop("score", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS * WIDTH numbers

    @F.arrow_udf("double")
    @tidy
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([s for at in range(0, len(t), SLICE) for s in shared.value.scores(t.slice(at, SLICE).to_pylist()).tolist()], pa.float64())

    limit = F.lit(model.threshold)
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return docs.withColumn("score", score("text")).withColumn("toxic", F.col("score") >= limit)
