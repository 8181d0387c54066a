"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A text's set is its distinct five-word shingles (letters and digits of any script,
lower case; one to four words: the whole sequence; no word: the empty set). An item
is contained in a document if at least ``THRESHOLD`` of its shingles are there.

Items are partitioned by the size of their set into classes of powers of two, and
each keeps a bottom-m MinHash sketch: its m smallest 64-bit shingle hashes, where m
follows from the class's upper size u as u - ceil(THRESHOLD * u) + 1. By counting,
a document that holds enough of the item holds at least one of any m of its
shingles, so the search loses nothing, however long the document is: documents
probe the sketches with all their hashes, and skip classes too large for them.
What the search finds is then verified on the shingles themselves.

DataFrame functions only. One pass over the documents, without a shuffle, while the
sketches are within ``LITERAL_ROWS``; beyond that, hashes are joined by a shuffle.

Defined results: null and empty texts match nothing; each row of a repeated
document gives its own rows; an empty table gives no rows; extra columns are
ignored by ``contained`` and kept by ``decontaminated``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, stored

THRESHOLD, WORDS = 0.8, 5
#: Sketch entries that may be literals of the plan; ids of documents to remove that may be broadcast.
LITERAL_ROWS, BROADCAST_IDS = 50_000, 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def held(value: Column) -> Column:
    """A generator that yields value once, as a column: the optimizer cannot copy its expression into each use."""
    return F.explode_outer(F.array(value))


def each_shingle(w: Column, make, width: int = WORDS) -> Column:
    """The distinct values of make(words of a shingle), for every shingle of the words w."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make(*[F.get(w, i + k) for k in range(width)]))
    few = F.array(*[F.when(F.size(w) == n, make(*[F.get(w, F.lit(k)) for k in range(n)])) for n in range(1, width)])
    return F.array_distinct(F.when(F.size(w) >= width, many).otherwise(F.filter(few, lambda s: s.isNotNull())))


def strings(w: Column) -> Column:
    return each_shingle(w, lambda *ws: F.concat_ws(" ", *ws))


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, shingles, n_item, need, sketch (ascending hashes) of every item that has a word."""
    sets = items.select("item_id", held(words(F.col("text"))).alias("w")).select("item_id", strings(F.col("w")).alias("shingles"), each_shingle(F.col("w"), F.xxhash64).alias("h"))
    sized = sets.withColumn("n_item", F.size("shingles")).where("n_item > 0")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))
    need = lambda n: F.ceil(F.lit(threshold) * n - 1e-9)
    return sized.select("item_id", "shingles", "n_item", need(F.col("n_item")).cast("int").alias("need"), F.slice(F.sort_array("h"), 1, F.least(upper - need(upper) + 1, "n_item").cast("int")).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every document row and item with enough in common."""
    wanted = stored(sketches(items, threshold))
    entries = wanted.select("*", F.explode("sketch").alias("probe"))
    n_entries = entries.count()
    texts = docs.select("doc_id", held(words(F.col("text"))).alias("w"))
    hashed = texts.select("doc_id", "w", held(each_shingle(F.col("w"), F.xxhash64)).alias("h"))
    if n_entries <= LITERAL_ROWS:
        # documents that meet no sketch leave before anything is multiplied by their length
        known = [r.probe for r in entries.select("probe").distinct().collect()]
        met = hashed.select("doc_id", "w", "h", held(F.filter("h", lambda x: x.isin(known))).alias("hits")).where(F.size("hits") > 0)
        probes = met.select("doc_id", "w", "h", F.explode_outer("hits").alias("probe"))
        met = probes.join(hinted(entries, n_entries, LITERAL_ROWS), "probe").where(F.size("h") >= F.col("need"))
        # of several sketch entries that meet, the least stands for the pair
        pairs = met.where(F.array_min(F.array_intersect("sketch", "h")) == F.col("probe"))
    else:
        hits = hashed.select("doc_id", F.explode_outer("h").alias("probe")).join(entries.select("item_id", "probe"), "probe").select(F.col("doc_id").alias("hit_id"), "item_id").distinct()
        pairs = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id"))).select("doc_id", "item_id", "w").join(wanted, "item_id")
    exact = pairs.select("doc_id", "item_id", "n_item", "need", F.size(F.array_intersect("shingles", strings(F.col("w")))).alias("n_shared"))
    return exact.where("n_shared >= need").select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that contain an item; a null doc_id counts as a value of its own."""
    found = stored(contained(docs, items, threshold).select(F.col("doc_id").alias("found_id")).distinct())
    found = hinted(found, found.count(), BROADCAST_IDS)
    return docs.join(found, docs.doc_id.eqNullSafe(found.found_id), "left_anti")
