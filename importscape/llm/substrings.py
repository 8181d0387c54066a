"""Exact substring dedup: prefix doubling over distributed positions.

Removes every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id; all strings are judged on the input.

Positions get ranks for growing lengths by doubling: the rank for 2n bytes is the
name of the pair (rank at the position, rank n bytes on). Ranks are 64-bit names of
their pairs rather than numbers in a sorted order, so a doubling needs no exchange
and equal strings have equal ranks in every document. Spark brings equal ranks
together, sorts them and reranks at growing lengths, and what is unique drops out:

1. At ``ANCHOR`` bytes. Of all positions, each string of ``LENGTH`` bytes is stood for
   by the least rank of ``ANCHOR`` bytes inside it (the leftmost, if it repeats);
   equal strings have equal representatives at equal places. A representative's
   strings form one stretch of text, whose name is its context. Representatives that
   lie in one document only drop out. Of those with equal contexts, all but the
   smallest document's are decided: their stretches are removed. The smallest
   document's is decided too (it stays), unless the rank has other contexts.
2. At ``LENGTH`` bytes, for the strings of the undecided stretches alone.

Exact copies are found by SHA-256 before that and take no part. Names are 64 bits
wide: two given different strings meet with a chance of 2**-64.

Entries travel in sorted, compressed blocks, one for each batch of documents and
part of the rank space; there is a part for every ``PART_BYTES`` of text, so that a task
holds as much of the ranks however large the input is. A string that very many documents share is one
run of equal ranks in one part, a few bytes for each of them.

Defined results: null text is empty; texts under ``LENGTH`` bytes lose nothing; rows
without an id lose nothing and remove nothing; rows that share an id do not remove
from each other; each row of a repeated document has its own row in the result; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, looked_up, stored
from .hashing import buffers, mixed, span_hashes

LENGTH, ANCHOR = 50, 24
PLACE_BITS = np.uint64(24)  # of a place in a buffer; longer texts are cut into buffers that overlap
BUFFER = 1 << 20
#: Bytes of text that a task works on at a time.
PORTION = 8 << 20
#: Bytes of text for each part of the rank space, whose entries take about as many.
PART_BYTES = 32 << 20
#: Ids that may be broadcast to thin documents out before a shuffle.
BROADCAST_IDS = 500_000
COVERED, OPEN = 1, 2
NAMES = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of each pair of ranks."""
    n = a * np.uint64(0x9E3779B97F4A7C15) + b
    n ^= n >> np.uint64(29)
    n *= np.uint64(0xBF58476D1CE4E5B9)
    n ^= n >> np.uint64(32)
    return n


def ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all strings of that length, by doubling; the bits of the length say which doublings it is made of."""
    rank, size, out, done = NAMES[raw], 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, done = rank, size
            else:  # the longer part first
                n = len(raw) - done - size + 1
                out, done = pair(rank[:n], out[size : size + n]), done + size
        if done == length:
            return out
        if len(rank) <= size:
            return np.zeros(0, np.uint64)
        rank, size = pair(rank[:-size], rank[size:]), size * 2


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of that width, by doubling."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Stretches:
    """The representatives of a buffer's strings: text number, start and end of the starts they stand for, rank, key."""

    def __init__(self, raw: np.ndarray, places: np.ndarray):
        empty = np.zeros(0, np.int64)
        self.text = self.first = self.last = empty
        self.rank = self.key = np.zeros(0, np.uint64)
        if len(raw) < LENGTH:
            return
        rank, width = ranks(raw, ANCHOR), LENGTH - ANCHOR + 1
        low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
        owner = (least_of(rank & ~low | np.arange(len(rank), dtype=np.uint64), width) & low).astype(np.int64)
        text = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(owner)]
        # each text is followed by a newline that is not its own
        valid = np.arange(len(owner)) + LENGTH < places[1:][text]
        starts = np.flatnonzero(valid & ((np.diff(owner, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)))
        if not len(starts):
            return
        ends = np.append(starts[1:], len(owner)) - 1
        limit = places[1:][text[starts]] - LENGTH - 1
        self.text, self.first, self.last = text[starts], starts, np.minimum(ends, limit)
        at = owner[starts]
        self.rank = mixed(rank[at])  # the least of many are small numbers; mixed, they spread over all parts
        context = span_hashes(raw, starts, self.last + LENGTH)
        self.key = mixed(pair(self.rank, pair(context, (at - starts).astype(np.uint64))))


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, places, text numbers, offsets in their texts) of buffers; a long text comes in pieces that overlap by one string."""
    step = (1 << int(PLACE_BITS)) - BUFFER
    cut = [(k, at, t[at : at + step + LENGTH - 1]) for k, t in enumerate(texts) for at in range(0, max(len(t) - LENGTH + 1, 1), step)]
    for first, data, places in buffers([t for _, _, t in cut], BUFFER):
        own = cut[first : first + len(places) - 1]
        yield np.frombuffer(data, np.uint8), places, np.array([k for k, _, _ in own]), np.array([at for _, at, _ in own])


def packed(batch: int, parts: int, docs: np.ndarray, text: np.ndarray, rank: np.ndarray, key: np.ndarray | None) -> Iterator[dict]:
    """A batch's entries as one block for each part of the rank space, sorted by rank."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(rank, kind="stable")
    rank, text = rank[order], text[order]
    key = key[order] if key is not None else None
    cuts = np.searchsorted((rank >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            used, local = np.unique(text[a:b], return_inverse=True)
            yield {
                "part": p,
                "batch": batch,
                "docs": pack(np.diff(docs[used], prepend=0).tobytes()),
                "text": pack(local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes()),
                "rank": pack(np.diff(rank[a:b], prepend=np.uint64(0)).tobytes()),
                "key": key[a:b].tobytes() if key is not None else b"",
            }


BLOCK = "part int, batch long, docs binary, text binary, rank binary, key binary"


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The doc_id, rank and key (the rank itself, if there is none) of a block's entries."""
    import zstandard

    read = zstandard.ZstdDecompressor().decompress
    docs, rank = np.cumsum(np.frombuffer(read(row.docs), np.int64)), np.cumsum(np.frombuffer(read(row["rank"] if hasattr(row, "keys") else row.rank), np.uint64), dtype=np.uint64)
    text = read(row.text)
    local = np.frombuffer(text, np.uint16 if len(text) == 2 * len(rank) else np.uint32)
    return docs[local], rank, np.frombuffer(row.key, np.uint64) if row.key else rank


def shared(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries, sorted by rank, whose rank is in more than one document."""
    first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return np.flatnonzero(np.repeat(many, np.diff(np.append(first, len(rank)))))


def decided(rank: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """COVERED, OPEN or 0 for each entry: contexts of one rank that a smaller document has; else, if the rank has others."""
    out = np.zeros(len(rank), np.int8)
    order = np.lexsort((key, rank))
    r, k, d = rank[order], key[order], doc[order]
    if not len(r):
        return out
    new_rank = np.concatenate([[True], r[1:] != r[:-1]])
    new = new_rank | np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(r))))
    ranks_at = np.flatnonzero(new_rank)
    contexts = np.repeat(np.add.reduceat(new.astype(np.int64), ranks_at), np.diff(np.append(ranks_at, len(r))))
    out[order] = np.where(d > least, COVERED, np.where(contexts > 1, OPEN, 0))
    return out


def reranked(blocks: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, covered, open) from blocks: keys of entries as ascending numbers in bytes, for each document that has any.

    whole: equal ranks are equal strings, so that no contexts are compared.
    """
    answer = "part int, batch long, docs binary, text binary, rank binary, key binary"

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        read = [unpacked(r) for r in rows.itertuples(index=False)]
        doc, rank, key = (np.concatenate(x) for x in zip(*read, strict=True))
        batch = np.repeat(rows.batch.to_numpy(), [len(r) for _, r, _ in read])
        order = np.argsort(rank, kind="stable")
        kept = order[shared(rank[order], doc[order])]
        flag = decided(rank[kept], key[kept] * np.uint64(not whole), doc[kept])
        kept, flag = kept[flag > 0], flag[flag > 0]
        by = np.argsort(batch[kept], kind="stable")
        kept, flag = kept[by], flag[by]
        cuts = np.flatnonzero(np.diff(batch[kept], prepend=-1, append=-1)) if len(kept) else np.zeros(1, int)
        made = [{"part": 0, "batch": int(batch[kept[a]]), "docs": doc[kept[a:b]].tobytes(), "text": flag[a:b].tobytes(), "rank": b"", "key": key[kept[a:b]].tobytes()} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame(made, columns=["part", "batch", "docs", "text", "rank", "key"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        doc, flag, key = (np.concatenate([np.frombuffer(b, t) for b in rows[c]]) for c, t in (("docs", np.int64), ("text", np.int8), ("key", np.uint64)))
        order = np.lexsort((key, flag, doc))
        doc, flag, key = doc[order], flag[order], key[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
            f, k = flag[a:b], key[a:b]
            out.append((int(doc[a]), np.unique(k[f == COVERED]).tobytes(), np.unique(k[f == OPEN]).tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "covered", "open"])

    judged = blocks.groupBy("part").applyInPandas(judge, answer)
    return judged.groupBy("batch").applyInPandas(gather, "doc_id long, covered binary, open binary")


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def numbers(data: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(data or b"", np.uint64))


def encoded(texts) -> list[bytes]:
    return [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]


def portions(batches: Iterator[pd.DataFrame], most: int = PORTION) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows with their texts as bytes, about ``most`` bytes at a time."""
    for batch in batches:
        texts, at, size = [], 0, 0
        for k, text in enumerate(batch.text):
            texts += encoded([text])
            size += len(texts[-1])
            if size >= most or k == len(batch) - 1:
                yield batch.iloc[at : k + 1], texts
                texts, at, size = [], k + 1, 0


def of_texts(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Names of keys that hold for one text only."""
    return pair(keys, text.astype(np.uint64) + np.uint64(1))


def wanted_of(columns: list[np.ndarray]) -> np.ndarray:
    """The ascending names of the keys of each text."""
    if not columns:
        return np.zeros(0, np.uint64)
    return np.sort(of_texts(np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate(columns)))


def batch_number(k: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + k


def stretch_blocks(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, (batch, texts) in enumerate(portions(batches)):
            found = []
            for raw, places, text, _ in pieces(texts):
                s = Stretches(raw, places)
                found.append((text[s.text], s.rank, s.key))
            if found:
                text, rank, key = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame(packed(batch_number(n), parts, batch.doc_id.to_numpy(np.int64), text, rank, key), columns=["part", "batch", "docs", "text", "rank", "key"])

    return docs.select("doc_id", "text").mapInPandas(run, BLOCK)


def string_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of the ranks at LENGTH of the strings in open stretches. docs: doc_id, text, open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, (batch, texts) in enumerate(portions(batches)):
            found, wanted = [], wanted_of([numbers(o) for o in batch.open])
            for raw, places, text, _ in pieces(texts):
                s = Stretches(raw, places)
                if not len(s.text):
                    continue
                own = member(of_texts(text[s.text], s.key), wanted)
                size = s.last[own] - s.first[own] + 1
                at = np.repeat(s.first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append((text[np.repeat(s.text[own], size)], ranks(raw, LENGTH)[at]))
            if found:
                text, rank = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame(packed(batch_number(n), parts, batch.doc_id.to_numpy(np.int64), text, rank, None), columns=["part", "batch", "docs", "text", "rank", "key"])

    return docs.select("doc_id", "text", "open").mapInPandas(run, BLOCK)


def cut_out(texts: list[bytes], covered: list[np.ndarray], strings: list[np.ndarray]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """For each text, what is left and the removed spans. covered, strings: its keys at either step."""
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    edge, by_key, by_rank = np.zeros(begins[-1] + 1, np.int32), wanted_of(covered), wanted_of(strings)
    for raw, places, text, offset in pieces(texts):
        s = Stretches(raw, places)
        if not len(s.text):
            continue
        base = begins[text] + offset - places[:-1]
        own = member(of_texts(text[s.text], s.key), by_key)
        np.add.at(edge, s.first[own] + base[s.text[own]], 1)
        np.add.at(edge, s.last[own] + LENGTH + base[s.text[own]], -1)
        if len(by_rank):
            rank = ranks(raw, LENGTH)
            piece = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(rank)]
            fits = np.flatnonzero(np.arange(len(rank)) + LENGTH < places[1:][piece])
            at = fits[member(of_texts(text[piece[fits]], rank[fits]), by_rank)]
            at += base[piece[at]]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    gone = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    bounds = np.searchsorted(turns, begins)
    for text, begin, a, b in zip(texts, begins, bounds[:-1], bounds[1:], strict=False):
        spans = (turns[a:b] - begin).reshape(-1, 2).tolist()
        left, at = [], 0
        for start, end in spans:
            left.append(text[at:start])
            at = end
        yield b"".join([*left, text[at:]]), spans


def thinned(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined semi or anti with ids, by broadcast while they are few."""
    return docs.join(hinted(ids, ids.count(), BROADCAST_IDS), ["doc_id", "sha"], how)


def joined_by_id(found: DataFrame, shared_ids: bool) -> DataFrame:
    """One row an id where several texts share one; keys are names of strings, so they hold for each of its texts."""
    if not shared_ids:
        return found
    join = lambda c: F.aggregate(F.collect_list(c), F.lit(b""), lambda a, b: F.concat(a, b)).alias(c)
    return found.groupBy("doc_id").agg(join("covered"), join("open"))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for every row of docs.

    kept is the text that is left, as bytes, and spans the removed [start, end) in
    bytes; both are null where nothing, or all, is removed.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    seen = stored(own.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    least = seen.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("least_id"))
    marked = stored(looked_up(seen, least, "sha", "left"))
    n_bytes = seen.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    copies = marked.where("doc_id > least_id").select("doc_id", "sha").distinct()
    originals = thinned(own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), copies, "left_anti")
    texts = seen.where("doc_id is not null").distinct().groupBy("doc_id").count()
    shared_ids = not texts.where("count > 1").isEmpty()
    first = stored(joined_by_id(reranked(stretch_blocks(originals, parts), whole=False), shared_ids))
    undecided = first.where(F.length("open") > 0).select("doc_id", "open")
    few = hinted(undecided.select("doc_id"), undecided.count(), BROADCAST_IDS)
    # a rank that is shared at this length is covered in all but the smallest document
    second = reranked(string_blocks(originals.join(few, "doc_id", "left_semi").join(undecided, "doc_id"), parts), whole=True)
    second = stored(joined_by_id(second, shared_ids).select("doc_id", F.col("covered").alias("strings")).where(F.length("strings") > 0))
    found = stored(first.where(F.length("covered") > 0).select("doc_id", "covered").join(second, "doc_id", "full"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, texts in portions(batches):
            cut = cut_out(texts, [numbers(c) for c in batch.covered], [numbers(c) for c in batch.strings])
            rows = [(doc_id, sha, len(text) - len(left), hashlib.sha256(left).hexdigest(), left, spans) for doc_id, sha, text, (left, spans) in zip(batch.doc_id, batch.sha, texts, cut, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "sha", "n_removed", "kept_sha256", "kept", "spans"])

    few = hinted(found.select("doc_id"), found.count(), BROADCAST_IDS)
    touched = originals.join(few, "doc_id", "left_semi").join(found, "doc_id")
    cuts = touched.mapInPandas(cut, "doc_id long, sha string, n_removed long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>").dropDuplicates(["doc_id", "sha"])
    copy = F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))
    joined = marked.join(cuts, ["doc_id", "sha"], "left")
    n_removed = F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    n_spans = F.when(copy, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long")
    sha = F.when(copy, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha"))
    return joined.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), sha.alias("kept_sha256"), "kept", "spans")
