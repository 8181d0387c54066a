import numpy as np
import pytest
from pyspark.sql import functions as F

from importscape.llm import neighbours


def search(spark, rows, wanted=5, **given):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted(map(tuple, neighbours.neighbours(v, F.col("vec_id") % 20 == 0, wanted, **given).collect()))


def by_force(rows, wanted):
    fine = [(i, np.array(e, np.float32).astype(float)) for i, e, _ in rows if i is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)]
    out = []
    for q, x in fine:
        if q % 20 == 0:
            near = sorted((-(x * y).sum(), i) for i, y in fine if i != q and len(y) == len(x))[:wanted]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def recall(got, wanted):
    return len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in wanted}) / len(wanted)


ODD = [(300, None, 0), (320, [], 0), (340, [0.0] * 8, 0), (360, [float("nan")] * 8, 0), (380, [None, 1.0], 0), (400, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (401, [3.0, -0.0], 0)]


def test_odd_vectors_copies_and_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 8)], 0) for i in range(150)] + [(200 + i, [3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.0], 0) for i in range(60)] + ODD
    got, wanted = search(spark, rows), by_force(rows, 5)
    assert recall(got, wanted) >= 0.9 and len(got) == len(wanted)
    vectors = {i: np.array(e, np.float32).astype(float) for i, e, _ in rows if e}
    assert all(s == pytest.approx((vectors[a] * vectors[c]).sum(), abs=1e-12) for a, _, c, s in got)
    for q in {r[0] for r in got}:
        mine = [r for r in got if r[0] == q]
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda r: (-r[3], r[2]))
    assert [r[:3] for r in got if r[0] == 400] == [(400, 1, 401)]  # the only other vector of its length
    assert [r[2] for r in got if r[0] == 200] == [201, 202, 203, 204, 205]  # copies tie to smaller ids
    assert search(spark, rows[:0]) == []


def test_all_candidates_if_there_are_fewer(spark):
    rows = [(i, np.random.default_rng(i).normal(size=16).tolist(), 0) for i in range(12)]
    got, wanted = search(spark, rows, 20), by_force(rows, 20)
    assert [r[:3] for r in got] == [r[:3] for r in wanted] and len(got) == 11


def test_columns_that_clash_are_ignored(spark):
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist(), 0) for i in range(8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = v.withColumns({c: F.lit("clash") for c in ("size", "rep", "ids", "query_id", "query_rep", "score", "rank", "place", "found")})
    every = F.col("vec_id") >= 0
    assert sorted(map(tuple, neighbours.neighbours(clash, every, 3).collect())) == sorted(map(tuple, neighbours.neighbours(v, every, 3).collect()))


@pytest.mark.parametrize(("size", "centers"), [(3, 0), (64, 0), (300, 100)])  # without structure, but for 300, where prefixes have one symbol
def test_recall_of_the_query(spark, size, centers):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, size)).astype(np.float32)
    if centers:
        x = (rng.normal(size=(centers, size))[rng.integers(0, centers, len(x))] + 0.5 * x).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = search(spark, rows, 20, shard_rows=1000)
    score = x[::20].astype(float) @ x.T.astype(float)
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    wanted = [(20 * k, 0, int(c), 0) for k, near in enumerate(np.argsort(-score, axis=1)[:, :20]) for c in near]
    assert recall(got, wanted) >= 0.9 and len(got) == len(wanted)


def measured(x, asked, shards):
    """Recall of the 20 nearest and share of the vectors that are scored, over the forests of shards."""
    full, short = neighbours.paths(neighbours.pointed(x[asked].astype(float)))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    nearest = np.argpartition(-score, 20, axis=1)[:, :20]
    found, scored = [set() for _ in asked], 0
    for rows in np.array_split(np.random.default_rng(1).permutation(len(x)), shards):
        order, keys = neighbours.planted(neighbours.stretched(x[rows].astype(float), np.sqrt((x.astype(float) ** 2).sum(1)).max()))
        least = int(np.ceil(neighbours.share_held(len(x), 21) * len(rows)))
        for k, among in enumerate(neighbours.Forest(order, keys, len(rows), x.shape[1] + 1).candidates(full, short, least)):
            found[k] |= set(rows[among].tolist())
            scored += len(among)
    return np.mean([len(f & set(n.tolist())) / 20 for f, n in zip(found, nearest, strict=True)]), scored / len(asked) / len(x)


@pytest.mark.parametrize(("n", "most"), [(10_000, 0.25), (50_000, 0.15), (200_000, 0.1)])
def test_recall_holds_and_the_scored_share_falls_as_the_table_grows(n, most):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, share = measured(x, rng.choice(n, 40, replace=False), -(-n // neighbours.SHARD_ROWS))
    print(f"{n} vectors without structure: recall {found:.3f}, scored {share:.4f}")
    assert found >= 0.9 and share < most


def test_members_of_a_dense_group_find_each_other():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((9000, 64)).astype(np.float32)
    x[:3000] = x[0] + 0.1 * rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = measured(x, rng.choice(3000, 40, replace=False), 2)
    assert found >= 0.9
