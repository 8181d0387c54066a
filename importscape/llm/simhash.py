"""SimHash near-duplicates, linked by Burkhard-Keller trees.

A fingerprint's bit is one if it is set in over half of the XXH64 hashes (seed 42)
of the text's three-word shingles, repeats included. Fingerprints link if they
differ in at most ``RADIUS`` bits; a group is a connected component of the links.

Two fingerprints within radius 2 agree on one of three blocks of their bits, so
each distinct fingerprint is sent to three shards (block, its bits). Each shard's
tree is built and probed where its rows are: a node's children are keyed by their
Hamming distance to it, and a search follows only edges within the radius. The
trees hold every distinct fingerprint of the corpus, which has no size bound, so
they are sent to the shards that probe them and not broadcast to all.

A shard over ``SHARD_ROWS`` splits its free bits into three again, twice at most:
then 19 free bits are left, so no shard can exceed 2**19 rows. No pair is lost and
none is emitted: a shard returns a spanning star of each of its own components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, looked_up, stored
from .components import components

RADIUS, BITS, SEED, WORDS = 2, 64, 42, 3
SHARD_ROWS = 4096
#: Ids of dropped documents that may be broadcast (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 500_000
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Of a text's word shingles, in their order; none without words, one if there are fewer words than that."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(len(tokens) - words + 1, 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of a text's word shingles; zero without words."""
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    if not n:
        return 0
    by_byte = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, bits) for every row of docs; null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "bits": np.fromiter((signed(fingerprint(t if isinstance(t, str) else None, words)) for t in batch.text), np.int64, len(batch))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, bits long")


class Tree:
    """Burkhard-Keller tree over numbers of any width; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int = RADIUS) -> list[int]:
        """Inserts a value; returns the places of earlier values within the radius."""
        found, place = [], len(self.values)
        hang = None
        stack = [(0, True)] if self.values else []  # (node, on the path where the value will hang)
        while stack:
            k, own = stack.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            below = self.children[k]
            if own and d not in below:
                hang = (k, d)
            for e in range(max(d - radius, 0), d + radius + 1):
                if e in below:
                    stack.append((below[e], own and e == d))
        self.values.append(value)
        self.children.append({})
        if hang:
            self.children[hang[0]][hang[1]] = place
        return found


    def put(self, value: int) -> None:
        """Inserts a value without a search."""
        k = 0
        while self.values and (e := (self.values[k] ^ value).bit_count()) in self.children[k]:
            k = self.children[k][e]
        if self.values:
            self.children[k][e] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> bool:
        """Whether any value lies within the radius; the search ends at the first it finds."""
        stack = [0] if self.values else []
        while stack:
            k = stack.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                return True
            stack += [c for e, c in self.children[k].items() if d - radius <= e <= d + radius]
        return False


def shard_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A star for each component of distinct signed values: (value, least of its component)."""
    tree, parent = Tree(), list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, v in enumerate(values):
        for j in tree.add(v & (2**64 - 1), radius):
            if (a := root(k)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    return [(values[k], values[root(k)]) for k in range(len(values)) if root(k) != k]


def thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[n * i // 3 : n * (i + 1) // 3] for i in range(3)]


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): edges that connect just what links within ``RADIUS`` connect. distinct: bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [e for values in batch["values"] for e in shard_edges(sorted(int(v) for v in values))]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    out, rows, free = None, distinct.select("bits", F.lit(0).cast("long").alias("path")), {0: list(range(BITS))}
    for level in range(3):
        parts, below = [], {}
        for path, bits in free.items():
            for i, block in enumerate(thirds(bits)):
                mask, step = signed(sum(1 << b for b in block)), path * 3 + i + 1
                below[step] = [b for b in bits if b not in block]
                # a split shard's rows keep its key, so rows meet only if they agree on all blocks so far
                parts.append((path, F.struct(F.lit(step).cast("long").alias("path"), F.xxhash64(F.lit(step), F.col("key") if level else F.lit(0), F.col("bits").bitwiseAND(F.lit(mask))).alias("key"))))
        chosen = F.array(*[s for _, s in parts]) if not level else F.filter(F.array(*[F.when(F.col("path") == p, s) for p, s in parts]), lambda s: s.isNotNull())
        keyed = rows.select("bits", F.explode(chosen).alias("s")).select("bits", "s.path", "s.key")
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counts = stored(counts)
        light = keyed.join(counts.where(F.col("n") <= shard_rows) if level < 2 else counts, "key", "left_semi")
        edges = light.groupBy("key").agg(F.collect_list("bits").alias("values")).select("values").mapInPandas(run, "u long, v long")
        out = edges if out is None else out.union(edges)
        heavy = counts.where(F.col("n") > shard_rows)
        if level == 2 or heavy.isEmpty():
            return out
        rows, free = stored(keyed.join(heavy, "key", "left_semi")), below
    return out


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, bits, component_id) for every row of docs.

    component_id is the smallest doc_id in the group, null where no row of the
    group has an id. Null and empty texts have fingerprint zero and link like any
    other; repeated rows each get their row; extra columns are ignored.
    """
    prints = stored(fingerprints(docs, words))
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    nodes = stored(components(links(distinct.select("bits"))))
    joined = distinct.join(nodes.withColumnRenamed("node", "bits"), "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), "first_id")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "root").select("bits", "component_id")
    return looked_up(prints, named, "bits")  # copies share their bits


def first_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; one row stays of rows that share an id.

    grouped: doc_id, component_id. Rows without an id cannot stand for a group and are kept as they are.
    """
    found = stored(grouped.select("doc_id", "component_id"))
    dropped = found.where("doc_id > component_id").select("doc_id").distinct()
    kept = docs.join(hinted(dropped, dropped.count(), BROADCAST_IDS), "doc_id", "left_anti")
    if found.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty():
        return kept.select(docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null")).select(docs.columns)


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id, as ``first_of_each`` says."""
    return first_of_each(docs, groups(docs, words))
