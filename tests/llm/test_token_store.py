import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from importscape.llm import queries, token_store

PATH = queries.tokenizer_path("word_bpe_49k.json")


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_words_encode_as_whole_texts_do():
    texts = ["", "Hello  World\tit's\n100% İstanbul Σίσυφος", "a\x0bb\x0cc\x85d\xa0e f　g\x1ch", "<|endoftext|>x<|startoftext|> é é ́x", "one", "one two " * 50, "你好 \U0001f600!!! ..."]
    assert [[*map(int, i)] + [1] for i in token_store.WordEncoder(PATH)(texts)] == [whole(t) for t in texts]


def test_forgetting_words_changes_nothing():
    e = token_store.WordEncoder(PATH, cache_words=8)
    for t in ["a b c", "d e f g", "a b h i j", "a b c d e f g h i"]:
        assert [*map(int, e([t])[0]), 1] == whole(t)


def test_round_trip(spark, odd, tmp_path):
    manifest = token_store.write_shards(odd, PATH, out_dir=str(tmp_path / "s"))
    got = sorted(map(tuple, token_store.read_shards(manifest).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, wanted = 0, []
    for doc_id, text in rows:
        ids = whole(text)
        wanted.append((doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == wanted


def test_lookup(tmp_path):
    path = str(tmp_path / "x.sst")
    ids = [None, -5, *range(0, 4000, 2), 2**62]
    with open(path, "wb") as f:
        w = token_store.ShardWriter(f, 2)
        for i in ids:
            w.add(token_store.key_bytes(i), np.full(100, (i or 0) % 60000, np.uint16))
        with pytest.raises(ValueError):
            w.add(token_store.key_bytes(3), np.zeros(1, np.uint16))
        w.close()
    r = token_store.ShardReader(path)
    assert len(r.index) > 1 and [token_store.key_id(k) for k, _ in r.scan()] == ids
    assert all(r.get(i)[0] == (i or 0) % 60000 for i in ids)
    assert all(r.get(i) is None for i in (1, 3, 4001, -6))
    assert sum(r.may_hold(i) for i in range(1, 4000, 2)) < 100


def test_no_documents(documents):
    assert token_store.read_shards(token_store.write_shards(documents([]), PATH)).count() == 0


def test_plain_words_are_pieces_and_go_to_the_model():
    e = token_store.WordEncoder(PATH)
    assert e.direct
    e.learn_by_offsets = None  # none of these needs the whole pipeline
    texts = ["Größe, ÉTÉ... the #1 co-op! (naïve) 3.14 a_b @x?! ¿Qué? «où» $$$ ***wh***", "ß ÿ À xYz 100%", "word" * 100]
    assert [[*map(int, i)] + [1] for i in e(texts)] == [whole(t) for t in texts]
    odd = ["it's don't", "<|endoftext|> <b> x|y", "ª µ º ² œuvre", "é \xad"]
    assert [[*map(int, i)] + [1] for i in token_store.WordEncoder(PATH)(odd)] == [whole(t) for t in odd]
