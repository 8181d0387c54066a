"""SimHash near duplicates at a similarity: the fingerprints and trees of ``simhash``, wider and in many tables.

Two texts link if the sets of their ``WORDS``-word shingles have a Jaccard similarity of at
least ``SIMILARITY``; a group is a connected component of the links. Words are those of
``simhash``: lower case A-Z, split at ASCII white space.

At 0.8 two sets differ in 15 % of the bits of a SimHash fingerprint, ten of 64, a radius at
which a tree over all fingerprints prunes nothing. So each distinct set gets a fingerprint of
``CHECK + POOL`` bits, and ``tables`` many selections of bits of the pool deal it to shards,
one a table: as many bits as a shard needs to expect about two unrelated sets, and as many
tables as two sets at the similarity need to miss each other in all with a chance of
``MISS``, at most. Both follow from the count of the sets; tables grow with its 0.24th power.

A shard keeps Burkhard-Keller trees over the ``CHECK`` bits, one for each cluster so far; a
set joins the clusters in which a search finds one within the radius, and stops at the first
it finds there, so a large group of near copies costs a few steps for each. What a cluster
joins is then verified on the sets: each member against the cluster's least one, and, where
members are still in different groups, those outside of the largest group against all, in
blocks of ``BLOCK`` by ``BLOCK``. So no pair is emitted for members of one group, no task
holds more than two blocks of sets, and no link between members of a cluster is lost.

Defined results: null, empty and blank texts have the empty set and are equal; a text of
fewer words has one shingle, its whole sequence; each row of a repeated document gets its
row; extra columns are ignored by ``groups``. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, looked_up, stored, tidy
from .components import components
from .hashing import buffers, mixed, span_hashes, spans
from .simhash import Tree, first_of_each

WORDS, SIMILARITY, MISS = 5, 0.8, 0.003
#: Bits that trees compare, and bits that tables choose from.
CHECK, POOL = 128, 1024
#: Sets of a block of the last comparison; rows of a task that builds trees.
BLOCK, SHARD_TASK_ROWS = 512, 1_000_000
#: Texts whose sets a worker holds at once.
SLICE = 500
#: Ids of documents to read again that may be broadcast (8 bytes each); beyond it they are shuffled.
BROADCAST_NODES = 500_000
SPACE = np.array([c in b" \t\n\v\f\r" for c in range(256)])
_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 1 << 63, (CHECK + POOL) // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, ascending."""
    if words > len(_STEPS):
        raise ValueError(f"shingles of more than {len(_STEPS)} words")
    for _, data, places in buffers([(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass").lower() for t in texts]):
        raw = np.frombuffer(data, np.uint8)
        starts, ends = spans(~SPACE[raw])
        word = span_hashes(raw, starts, ends)
        cuts = np.searchsorted(starts, places)
        full = max(len(word) - words + 1, 0)
        every = np.zeros(full, np.uint64)
        for k in range(words):
            every += word[k : k + full] * _STEPS[k]
        every = mixed(every)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(every[a : b - words + 1])
            else:  # shorter sequences are shingles of their own
                yield mixed((word[a:b] * _STEPS[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def node(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of hashes; zero for the empty one."""
    if not len(hashes):
        return 0
    return int(mixed(mixed(hashes).sum(keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """``CHECK + POOL`` bits, each set if it is set in over half of the hashes' hashes."""
    ones = np.zeros(CHECK + POOL, np.int64)
    for at in range(0, len(hashes), 1024):
        bits = np.unpackbits(mixed(hashes[at : at + 1024, None] * _FACTORS).view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums that fit into a byte
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which two sets of that Jaccard similarity differ, at most, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float, miss: float = MISS) -> int:
    """The least radius of ``CHECK`` bits beyond which sets of that similarity lie with a chance of ``miss`` at most."""
    p, inside = differing(similarity), 0.0
    for r in range(CHECK + 1):
        inside += math.comb(CHECK, r) * p**r * (1 - p) ** (CHECK - r)
        if 1 - inside <= miss:
            return r
    return CHECK


def tables(sets: int, similarity: float, miss: float = MISS) -> np.ndarray:
    """(tables, bits): the bits of the pool that each table chooses."""
    bits = max(8, math.ceil(math.log2(max(sets, 2))) - 1)
    meet = (1 - differing(similarity)) ** bits
    count = math.ceil(math.log(miss) / math.log1p(-meet)) if meet < 1 else 1
    rng = np.random.default_rng(9)
    return np.stack([rng.choice(POOL, min(bits, POOL), replace=False) for _ in range(count)])


def named(docs: DataFrame, words: int, what: str) -> DataFrame:
    """(doc_id, node) of every row of docs, with its wide fingerprint or its set as ``what`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                sets = list(shingle_sets(part.column("text").to_pylist(), words))
                more = [s.tobytes() if what == "set" else wide_fingerprint(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([node(s) for s in sets], pa.int64()), pa.array(more, pa.binary())], ["doc_id", "node", what])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), f"doc_id long, node long, {what} binary")


def dealt(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(key, node, high, low): each node once a table, with the bits that trees compare. nodes: node, bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.uint64(1) << np.arange(chosen.shape[1], dtype=np.uint64)
        table = mixed(np.arange(len(chosen), dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                raw = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
                bits = np.unpackbits(raw[:, CHECK // 8 :], axis=1)
                code = np.stack([bits[:, c].astype(np.uint64) @ weights for c in chosen], 1)
                check = raw[:, : CHECK // 8].copy().view(np.int64)
                n = len(chosen)
                yield pd.DataFrame({"key": mixed(code + table).view(np.int64).ravel(), "node": np.repeat(part.node.to_numpy(np.int64), n), "high": np.repeat(check[:, 0], n), "low": np.repeat(check[:, 1], n)})

    return nodes.select("node", "bits").mapInPandas(tidy(run), "key long, node long, high long, low long")


def clusters_of(values: list[int], within: int) -> list[int]:
    """For each value the number of its cluster: values that are linked by steps within the radius, found by trees."""
    trees: list[Tree] = []
    parent: list[int] = []  # of the trees of one cluster
    own = []

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for v in values:
        hits: list[int] = []
        for t, tree in enumerate(trees):
            r = root(t)
            if r not in hits and tree.near(v, within):
                hits.append(r)
        if hits:
            for h in hits[1:]:
                parent[h] = hits[0]
            trees[hits[0]].put(v)
            own.append(hits[0])
        else:
            trees.append(Tree())
            trees[-1].put(v)
            parent.append(len(trees) - 1)
            own.append(len(trees) - 1)
    return [root(k) for k in own]


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition that is sorted by key, cut only between keys."""
    held: list[pd.DataFrame] = []  # the last key may go on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        key = batch.key.to_numpy()
        if held and held[0].key.iloc[0] == key[-1]:
            held.append(batch)
            continue
        last = key == key[-1]
        if held or not last.all():
            yield pd.concat([*held, batch[~last]], ignore_index=True)
        held = [batch[last]]
    if held:
        yield pd.concat(held, ignore_index=True)


def clustered(rows: DataFrame, parts: int, within: int) -> DataFrame:
    """(key, v, u): the members u of every cluster of two or more in a shard, v the least of them. rows: as ``dealt`` gives."""

    def of_shards(frame: pd.DataFrame) -> pd.DataFrame:
        key, member = frame.key.to_numpy(), frame.node.to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(first, len(key)))
        high, low = frame.high.to_numpy().view(np.uint64), frame.low.to_numpy().view(np.uint64)
        twos = first[size == 2]
        apart = np.bitwise_count(high[twos] ^ high[twos + 1]).astype(int) + np.bitwise_count(low[twos] ^ low[twos + 1])
        twos = twos[apart <= within]
        least = np.minimum(member[twos], member[twos + 1])
        out = [(np.repeat(key[twos], 2), np.repeat(least, 2), np.stack([member[twos], member[twos + 1]], 1).ravel())]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            values = [(h << 64) | x for h, x in zip(high[a : a + n].tolist(), low[a : a + n].tolist(), strict=True)]
            label = np.array(clusters_of(values, within))
            if len(np.unique(label)) == n:
                continue
            order = np.argsort(label, kind="stable")
            cut = np.flatnonzero(np.diff(label[order], prepend=-1))
            held = np.diff(np.append(cut, n))
            v = np.repeat(np.minimum.reduceat(member[a : a + n][order], cut), held)
            many = np.repeat(held > 1, held)
            out.append((np.full(many.sum(), key[a]), v[many], member[a : a + n][order][many]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("key", "v", "u"), zip(*out, strict=True), strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches):
            yield of_shards(frame)

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(tidy(run), "key long, v long, u long")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough. sets: node, set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in zip(batch.a, batch.b, strict=True)]
            yield batch.loc[np.array(keep, bool), ["u", "v"]]

    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("set").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInPandas(tidy(run), "u long, v long")


def across(sets: list[np.ndarray], nodes: np.ndarray, label: np.ndarray, asks: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the asking sets of a block and all its sets of other groups (label); those that are one group by then are not compared."""
    label, size = label.copy(), np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    mark, found = np.zeros(len(values), np.int32), []
    for i in np.flatnonzero(asks):
        if (label == label[i]).all():
            break
        own = inverse[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[inverse], starts)
        mark[own] = 0
        for j in np.flatnonzero((both >= similarity * (size + size[i] - both) - 1e-9) & (label != label[i])):
            if label[j] != label[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


def compared(cells: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the links that ``across`` finds in each cell. cells: key, u, label, asks, set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches):
            cuts = [*np.flatnonzero(np.diff(frame.key.to_numpy(), prepend=frame.key.iloc[0] - 1)).tolist(), len(frame)]
            sets = [np.frombuffer(s, np.uint64) for s in frame["set"]]
            nodes, label, asks, found = frame.u.to_numpy(), frame.label.to_numpy(), frame.asks.to_numpy(), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found += across(sets[a:b], nodes[a:b], label[a:b], asks[a:b], similarity)
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return cells.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(run), "u long, v long")


def links(docs: DataFrame, distinct: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(u, v): edges that connect just what links among the members of clusters connect. distinct: node, bits, first_id."""
    spark = docs.sparkSession
    filled = distinct.where("bits is not null")
    chosen = tables(filled.count(), similarity)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-filled.count() * len(chosen) // SHARD_TASK_ROWS))
    clusters = stored(clustered(dealt(filled, chosen), parts, radius(similarity)))
    pairs = stored(clusters.where("u != v").select("u", "v").distinct())
    met = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    # the sets of what met are made again, from one document for each
    ids = stored(distinct.join(met, "node").where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct())
    again = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    again = again.join(hinted(ids, ids.count(), BROADCAST_NODES), "doc_id", "left_semi").union(again.where("doc_id is null"))
    sets = stored(named(again, words, "set").join(met, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))
    stars = stored(verified(pairs, sets, similarity))
    roots = components(stars)
    placed = stored(clusters.join(roots.withColumnRenamed("node", "u"), "u", "left").select("key", "v", "u", F.coalesce("root", "u").alias("label")))
    # clusters of two are settled; of equal ones in several tables one is enough
    several = placed.groupBy("key", "v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("name"), F.min("label").alias("least"), F.max("label").alias("most")).where("n > 2 and least != most")
    several = several.groupBy("v", "n", "name").agg(F.min("key").alias("key")).select("key", "v")
    rest = stored(placed.join(several, ["key", "v"], "left_semi"))
    sized = rest.groupBy("key", "v", "label").agg(F.count("*").alias("n")).groupBy("key", "v").agg(F.max(F.struct("n", "label")).alias("big"), F.sum("n").alias("n"))
    sized = sized.select("key", "v", F.col("big.label").alias("big"), F.ceil(F.col("n") / block).alias("rows"), F.ceil((F.col("n") - F.col("big.n")) / block).alias("columns"))
    cell = rest.join(sized, ["key", "v"])
    of = lambda count: F.pmod(F.xxhash64("u"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    all_ = cell.withColumn("a", of("rows")).withColumn("b", every("columns")).withColumn("asks", F.lit(False))
    asking = cell.where("label != big").withColumn("a", every("rows")).withColumn("b", of("columns")).withColumn("asks", F.lit(True))
    # cells whose hashes clash are compared as one, which finds no less
    cells = all_.union(asking).select(F.xxhash64("key", "v", "a", "b").alias("key"), "u", "label", "asks")
    return stars.union(compared(cells.join(sets.withColumnRenamed("node", "u"), "u"), similarity))


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs; component_id is the smallest doc_id of its group, null where none has an id."""
    prints = stored(named(docs, words, "bits"))
    distinct = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bits").alias("bits")))
    roots = stored(components(links(docs, distinct, words, similarity)))
    joined = distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return looked_up(prints.select("doc_id", "node"), looked_up(joined, least, "root").select("node", "component_id"), "node")


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; otherwise as ``simhash.first_of_each`` says."""
    return first_of_each(docs, groups(docs, words, similarity))
