import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from importscape.llm import simhash_wide


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def groups_by_force(texts):
    sets, parent = {i: shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            m, n = sorted((root(a), root(b)))
            parent[n] = m
    return {i: root(i) for i in texts}


def made():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(30):
        base = [word() for _ in range(r.randint(60, 400))]
        texts.append(base)
        for _ in range(6):  # chains of copies with some words changed, around the limit
            base = list(base if r.random() < 0.5 else texts[-1])
            for _ in range(max(1, len(base) * r.choice([1, 2, 3]) // 150)):
                base[r.randrange(len(base))] = word()
            texts.append(base)
    r.shuffle(texts)
    texts = [" ".join(t) for t in texts] + ["", None, "one two", "ONE  two", " "]
    return dict(enumerate(texts, 1))


def test_groups_against_brute_force(documents):
    texts = made()
    wanted = groups_by_force(texts)
    assert 10 < len(set(wanted.values())) < 0.8 * len(texts)
    assert {r.doc_id: r.component_id for r in simhash_wide.groups(documents(list(texts.items()))).collect()} == wanted


def test_stage_removes_near_copies(spark, documents, sf_dir):
    texts = made()
    kept = corpus_pipeline.one_of_each_group(spark, documents(list(texts.items())), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_by_force(texts).values()))


def test_odd_rows(odd, documents):
    kept = simhash_wide.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7]
    assert simhash_wide.groups(documents([])).count() == 0


def test_shingle_sets():
    texts = [None, "", " \t\n", "One two", "one  TWO", "two one", "a b c d e f", "x " * 50, "É é a b c d", "a\x0bb\x1cc d\xa0e f g h"]
    plain = [{tuple(w) for w in shingles("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x1c", "\x01").replace("\xa0", "\x02"))} for t in texts]
    found = [set(s.tolist()) for s in simhash_wide.shingle_sets(texts)]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(found[a] & found[b]) == len(plain[a] & plain[b])
    assert [len(f) for f in found] == [len(p) for p in plain]
    assert found == [set(s.tolist()) for t in texts for s in simhash_wide.shingle_sets([t])]


def test_wide_fingerprints_differ_as_expected():
    rng = np.random.default_rng(1)
    same, other = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
    a, b = (np.unpackbits(np.frombuffer(simhash_wide.wide_fingerprint(np.concatenate([same, o])), np.uint8)) for o in other)
    assert abs((a != b).mean() - simhash_wide.differing(0.8)) < 0.05


def test_clusters_of_values_against_force():
    r = random.Random(4)
    values = []
    for _ in range(12):
        values.append(r.getrandbits(128))
        for _ in range(6):
            v = r.choice(values)
            for _ in range(r.randint(1, 30)):
                v ^= 1 << r.randrange(128)
            values.append(v)
    found, parent = simhash_wide.clusters_of(values, 12), list(range(len(values)))
    for _ in values:
        for i, j in itertools.combinations(range(len(values)), 2):
            if (values[i] ^ values[j]).bit_count() <= 12:
                parent[i] = parent[j] = min(parent[i], parent[j])
    assert 3 < len(set(parent)) < len(values)
    assert {(found[i] == found[j]) == (parent[i] == parent[j]) for i, j in itertools.combinations(range(len(values)), 2)} == {True}


@pytest.mark.parametrize("block", [512, 3])
def test_members_that_the_least_one_does_not_settle(spark, documents, block):
    """Everything is in one cluster: groups must come out as by force, whatever the blocks."""
    r, word = random.Random(2), "abcdefgh"
    base = [r.choice(word) + str(k) for k in range(60)]
    texts = {}
    for i in range(1, 40):
        t = list(base)
        for k in r.sample(range(60), r.randint(1, 2)):
            t[k] = f"z{i}{k}"
        texts[i] = " ".join(t)
    docs = documents(list(texts.items()))
    distinct = simhash_wide.named(docs, 5, "bits").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bits").alias("bits"))
    edges = simhash_wide.links(docs, distinct, 5, 0.8, block).collect()
    names = {r.node: r.doc_id for r in simhash_wide.named(docs, 5, "bits").collect()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        m, n = sorted((root(names[e.u]), root(names[e.v])))
        parent[n] = m
    assert {i: root(i) for i in texts} == groups_by_force(texts)
