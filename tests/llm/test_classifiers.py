import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from importscape.llm import labelled, quality, queries, toxicity


def test_held_out_is_the_fifth(spark):
    rows = spark.range(300).select(F.col("id"), labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def measured(y, score, predicted):
    """Area under the curve, recall and precision of label 1, over the accuracy of the commoner label."""
    up, down = score[y == 1], score[y == 0]
    order = np.argsort(np.concatenate([down, up]), kind="stable")
    ranks = np.empty(len(order))
    values = np.concatenate([down, up])
    ranks[order] = np.arange(1, len(order) + 1)
    for v in np.unique(values):  # ties share their ranks
        ranks[values == v] = ranks[values == v].mean()
    auc = (ranks[len(down) :].sum() - len(up) * (len(up) + 1) / 2) / (len(up) * len(down))
    hits = ((predicted == 1) & (y == 1)).sum()
    return auc, hits / (y == 1).sum(), hits / max((predicted == 1).sum(), 1)


@pytest.mark.parametrize("name,label,least", [("op6_quality", "quality", (0.99, 0.95, 0.95)), ("op9_toxicity", "toxic", (0.97, 0.8, 0.9))])
def test_held_out_rows(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.1"
    got = spark.read.parquet(f"{sf_dir}/labels.parquet").join(queries.queries()[name](spark, sf_dir), "doc_id").where(f"held_out and {label} is not null").toPandas()
    found = measured(got[label].to_numpy(), got.score.to_numpy(), got.predicted.to_numpy())
    print(f"{name} on {len(got)} held-out rows of sf0.1: AUC {found[0]:.3f}, recall {found[1]:.3f}, precision {found[2]:.3f}")
    assert got.score.between(0, 1).all() and all(f >= m for f, m in zip(found, least, strict=True))


def test_the_sample_is_bounded_in_rows_and_bytes(spark, documents):
    docs = documents([(i, "x" * 100) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows, counts = labelled.sample(docs, labels, "toxic", per_class=20)
    assert rows.groupBy("y").count().where("count = 20").count() == 2 and sum(counts.values()) > 100
    assert labelled.sample(docs, labels, "toxic", per_class=20, most_bytes=1050)[0].count() == 10


def test_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    q = quality.scored(odd, quality.train(odd, none)).collect()
    assert len(q) == odd.count() and {r.score for r in q} == {0.5}
    t = toxicity.scored(odd, toxicity.train(odd, none, per_class=5))
    assert t.count() == odd.count() and t.select("score").distinct().count() == 1
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4, 5, 6, 7, 3)], "doc_id long, quality int, toxic int")
    assert quality.scored(odd, quality.train(odd, some)).where("score between 0 and 1").count() == odd.count()
    t = toxicity.scored(odd, toxicity.train(odd, some))
    assert t.where("score between 0 and 1 and toxic is not null").count() == odd.count()
    assert t.where("doc_id = 3").select("score").distinct().count() == 1


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([0 if k % 2 else 1, *rng.integers(2, 50, 3)]) for k in range(80)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(80)])
    w = quality.descend(rows, [np.ones(len(r)) for r in rows], y, np.ones(80))
    assert all(np.sign(w[r].sum() + w[-1]) == s for r, s in zip(rows, y, strict=True))


def test_features_do_not_depend_on_neighbours():
    texts = ["Aa bb Aa!!", None, "", "x " * 5000, "é É 1,2"]
    alone = [next(quality.features([t])) for t in texts]
    assert all((a == b).all() for a, b in zip(alone, quality.features(texts), strict=True))
    words = [next(toxicity.word_rows([t])) for t in texts]
    assert all((a == b).all() for a, b in zip(words, toxicity.word_rows(texts), strict=True))


def test_long_texts_pool_as_a_whole():
    m = toxicity.blank()
    rng = np.random.default_rng(2)
    m.embedding[:-1] = rng.normal(size=m.embedding[:-1].shape)
    for f in m.filters:
        f[:] = rng.normal(size=f.shape)
    words = rng.integers(0, toxicity.ROWS, (1000, toxicity.PARTS)).astype(np.int32)
    a, b = m.pooled(words), m.pooled(words, block=64)
    assert np.allclose(a[0], b[0], atol=1e-5) and (a[1] == b[1]).all()


def test_threshold_lies_in_the_gap():
    s, y = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])
    assert toxicity.best_threshold(s, y, np.ones(4)) == 0.5
    assert 0.005 < toxicity.best_threshold(s / 100, y, np.ones(4)) <= 0.008
