import random

import pytest
import xxhash

from importscape.llm import components, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "One two", "É é Ü ß a b c", "a\x0bb\x1cc d\xa0e f g", "x " * 500, "The cat THE CAT the cat sat"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def groups_by_force(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("shard_rows", [4096, 4])
def test_links(spark, shard_rows):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(20)}
    for _ in range(120):  # chains and clusters, some of them in one shard
        v = r.choice(sorted(values))
        for _ in range(r.randint(1, 4)):
            v ^= 1 << r.randrange(64 if r.random() < 0.5 else 8)
        values.add(v)
    values = [simhash.signed(v) for v in values]
    found = components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "bits long"), shard_rows)).collect()
    wanted = groups_by_force(values)
    linked = {v: w for v, w in wanted.items() if list(wanted.values()).count(w) > 1}
    assert {x.node: x.root for x in found} == linked


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def groups_of_rows(rows):
    """By force: (doc_id, component_id) of rows (doc_id, text)."""
    prints = [(r.doc_id, simhash.signed(plain(r.text))) for r in rows]
    roots = groups_by_force({v for _, v in prints})
    least = {}
    for i, v in prints:
        if i is not None:
            least[roots[v]] = min(i, least.get(roots[v], i))
    return {(i, least.get(roots[v])) for i, v in prints}


def test_groups_of_whole_documents_against_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()} == groups_of_rows(docs.collect())


def test_groups_and_what_stays(odd, documents):
    found = {(r.doc_id, r.component_id) for r in simhash.groups(odd).collect()}
    assert found == groups_of_rows(odd.select("doc_id", "text").collect())
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in found if c is not None})
    assert ids.count(None) == 2
    assert simhash.groups(documents([])).count() == 0
