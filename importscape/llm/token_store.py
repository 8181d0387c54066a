"""Token-ID / binary output: sorted-string-table shards of token ids.

A shard file holds documents in ascending key order:

    block*      zstd frame of entries: varint shared, varint unshared, varint value
                length, the unshared key bytes, the value (token ids, 2 or 4 bytes each)
    index       for each block: first key, offset, stored length, entries
    bloom       bit array over the keys, ``BLOOM_BITS`` bits a key
    footer      JSON with the places and counts of the above; then its length and MAGIC

Keys are compared as bytes: one byte for null (0) or not (1), then the id as a
big-endian 64-bit number with its sign bit flipped, so byte order is id order.
A lookup tests the Bloom filter, bisects the sparse index and reads one block.

Shards are ranges of the key, made by one range shuffle of the texts; each task
streams its rows into one file under a temporary name and renames it, so a task
that is run again after a lost executor replaces its own file and nothing else.

Defined results: null text is encoded as empty text (only the end id); null ids
sort first and keep their rows; rows that share an id are all kept, ordered by
text; an empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, give_back, remembered, stored, tidy

MAGIC = b"SSTTOK01"
BLOOM_BITS, BLOOM_HASHES = 10, 7
BLOCK_BYTES = 1 << 18
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_200_000
#: Rows of a batch whose texts are made strings at once.
SLICE = 500
#: White space of str.split() beyond the four characters at which every pre-tokenizer splits.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
PLAIN_SPACE = re.compile("[ \t\n\r]+")
#: Characters of plain words: they have one byte in Latin-1 and are composed forms. No mark begins a token of its own such as 's.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba")
MARKS, DIGITS = "!\"#$%&()*+,-./:;=?@[]^_`{}~\xa1\xbf\xab\xbb", "0123456789"
PLAIN_WORD = re.compile(f"[{LETTERS}{re.escape(MARKS)}{DIGITS}]+")
PIECE = re.compile(f"[{LETTERS}]+|[{re.escape(MARKS)}]+|[{DIGITS}]")
#: The alphabet of byte-level models, where the bytes of no visible character are numbered from 256; line ends stay, as they part the pieces.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTE_LETTERS = "".join("\n" if b == 10 else chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))


class WordEncoder:
    """Encodes with the tokenizers library, one white-space-separated word at a time, remembering words.

    Valid for vocabularies whose pre-tokenizer drops white space and never joins
    across it; ``test_token_store`` holds it against encoding of whole texts. Plain
    words go straight to the library's model if ``plain_pieces`` finds that the
    normalizer and the pre-tokenizer do nothing to them but what it does.
    Words are kept in two generations of at most half of ``cache_words``, so
    frequent ones stay when rare ones go.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache_words = cache_words

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.direct = self.plain_pieces()

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words and where each word's end: their pieces, in lower case and in the alphabet of byte-level models, through the model."""
        pieces, counts = [], []
        for w in words:
            if w.isalpha():
                pieces.append(w)
            else:
                pieces += PIECE.findall(w)
            counts.append(len(pieces))
        text = codecs.charmap_decode("\n".join(pieces).lower().encode(), "strict", BYTE_LETTERS)[0]
        ids = np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("pieces without an end")
        return ids, ends[np.array(counts) - 1]

    def plain_pieces(self) -> bool:
        """Whether the tokenizer gives every letter, mark, digit, change between them and long word the ids of their pieces."""
        tried = [w for c in LETTERS + MARKS + DIGITS for w in (c, c * 3, f"a{c}", f"{c}a", f"B{c}A.", f"1{c}2", f"!{c}?")] + ["ab" * 200, *(LETTERS + MARKS).split("z")]
        end = getattr(self.tokenizer.model, "end_of_word_suffix", None)  # it tells where a piece ends; without it only offsets do
        if not end or PLAIN_WORD.fullmatch(end) or any(PLAIN_WORD.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
        try:
            ids, ends = self.plain_ids(tried)
        except ValueError:
            return False
        return all(self.tokenizer.encode(w, add_special_tokens=False).ids == ids[a:b].tolist() for w, a, b in zip(tried, [0, *ends], ends))

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words."""
        if self.direct:
            plain = [w for w in words if PLAIN_WORD.fullmatch(w)]
            if plain:
                ids, ends = self.plain_ids(plain)
                self.keep(plain, ids, ends.tolist())
            words = [w for w in words if w not in self.young]
        if words:
            self.learn_by_offsets(words)

    def keep(self, words: list[str], ids: np.ndarray, ends: list[int]) -> None:
        data, at, width = ids.tobytes(), 0, self.dtype.itemsize
        for w, end in zip(words, ends, strict=True):
            end *= width
            self.young[w] = data[at:end]
            at = end

    def learn_by_offsets(self, words: list[str]) -> None:
        """Encodes words in one call; offsets tell whose the ids are."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found))
        self.keep(words, np.asarray(found.ids, self.dtype), np.searchsorted(starts, ends).tolist())

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, in order."""
        split = [PLAIN_SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        young, words = self.young, set().union(*split)
        if new := words.difference(young):
            if len(young) + len(new) > self.cache_words // 2:
                self.old, self.young = young, {}
                new, young = words, self.young
            old = self.old
            unknown = []
            for w in new:
                if w in old:
                    young[w] = old[w]
                else:
                    unknown.append(w)
            if unknown:
                self.learn(unknown)
        ids = {w: young[w] for w in words}.__getitem__  # a small table, where most words are found several times
        return [np.frombuffer(b"".join(map(ids, t)), self.dtype) for t in split]


def grouped(rows: Iterator[tuple], most_chars: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of rows (..., text) of about that many characters in all."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += len(row[-1])
        if chars >= most_chars:
            yield group
            group, chars = [], 0
    if group:
        yield group


def sliced(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[tuple]:
    """The rows of a batch; so many at once become Python's."""
    for at in range(0, len(batch), rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_words: int) -> WordEncoder:
    return WordEncoder(path, cache_words)


remembered(encoder.cache_clear)


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def key_id(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % (2**64) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Appends (key, ids) in ascending key order to one file; holds one block and the keys' hashes."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.pack = sink, width, zstandard.ZstdCompressor(level=1).compress
        self.block, self.first, self.last, self.entries = [], b"", b"", 0
        self.block_bytes, self.at, self.index, self.keys = 0, 0, [], []
        self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(f"<u{self.width}", copy=False).tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.sink.write(data)
            self.index.append([self.first.hex(), self.at, len(data), self.entries])
            self.at += len(data)
            self.block, self.block_bytes, self.entries = [], 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[bloom_places(k, bits)] = True
        index = self.pack(json.dumps(self.index).encode())
        packed = np.packbits(bloom, bitorder="little").tobytes()
        footer = json.dumps({"index": [self.at, len(index)], "bloom": [self.at + len(index), len(packed), bits], "docs": self.docs, "tokens": self.tokens, "width": self.width}).encode()
        for part in (index, packed, footer, struct.pack("<I", len(footer)), MAGIC):
            self.sink.write(part)


class ShardReader:
    """Opens a shard by its footer; scans it in order or looks one document up."""

    def __init__(self, path: str):
        import zstandard

        fs, p = file_system(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.index = json.loads(self.unpack(self._part("index")))
        self.firsts = [bytes.fromhex(x[0]) for x in self.index]

    def _part(self, name: str) -> bytes:
        at, n = self.footer[name][:2]
        return self.file.read_at(n, at)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, _ = self.index[k]
        data, i, key = self.unpack(self.file.read_at(n, at)), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            fresh, i = read_varint(data, i)
            length, i = read_varint(data, i)
            key = key[:shared] + data[i : i + fresh]
            i += fresh
            yield key, np.frombuffer(data, f"<u{self.footer['width']}", length // self.footer["width"], i)
            i += length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        bits = self.footer["bloom"][2]
        if not hasattr(self, "bloom"):
            self.bloom = self._part("bloom")
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key_bytes(doc_id), bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document of that id, by Bloom filter, bisection of the index and one block."""
        key = key_bytes(doc_id)
        if not self.index or not self.may_hold(doc_id):
            return None
        k = max(bisect_right(self.firsts, key) - 1, 0)
        while k > 0 and self.firsts[k] == key:  # rows that share an id may fill several blocks
            k -= 1
        for k in range(k, min(k + 2, len(self.index))):
            for found, ids in self.block(k):
                if found == key:
                    return ids
        return None


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, out_dir: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Writes (doc_id, text) as shards and returns their manifest: shard, path, docs, tokens, start.

    A worker remembers cache_words words at most, some 200 bytes each. An id takes two bytes if the vocabulary allows, else four. The manifest has one
    row a shard; ``start`` is the number of ids in the shards before it.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = file_system(out_dir)
        writer, encode, task = None, encoder(tokenizer_path, cache_words), TaskContext.get()
        name = f"{base}/shard-{task.partitionId():06d}.sst"
        temporary = f"{name}.{task.taskAttemptId()}.tmp"
        rows = ((d, t or "") for batch in batches for d, t in sliced(batch))
        for group in grouped(rows):
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(temporary)
                writer = ShardWriter(sink, encode.dtype.itemsize)
            for (doc_id, _), ids in zip(group, encode([t for _, t in group]), strict=True):
                writer.add(key_bytes(doc_id), np.append(ids, encode.dtype.type(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(temporary, name)
            made = {"shard": [task.partitionId()], "file": [name.rsplit("/", 1)[1]], "docs": [writer.docs], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(made, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
        rows = group = ids = writer = None
        give_back()  # all but the words, which the next task needs

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ordered.mapInArrow(write, "shard int, file string, docs long, tokens long"))
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    return made.select("shard", F.concat(F.lit(f"{out_dir}/"), "file").alias("path"), "docs", "tokens", F.coalesce(before, F.lit(0)).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row a stored document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch.path, batch.start, strict=True):
                rows, at = [], int(start)
                for key, ids in ShardReader(path).scan():
                    rows.append((key_id(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        return out.assign(doc_id=out.doc_id.astype("Int64"))

    spread = manifest.select("path", "start", "shard").repartition(max(1, manifest.count()), "shard")  # a manifest has one row a shard
    return spread.mapInPandas(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
