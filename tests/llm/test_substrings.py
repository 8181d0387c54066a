import hashlib
import random

import numpy as np
import pytest

from importscape.llm import queries, substrings


def by_force(docs):
    first = {}
    for i, t in docs:
        for s in range(len(t) - 49 if i is not None else 0):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - 49 if i is not None else 0):
            if first[t[s : s + 50]] < i:
                gone[s + 1 : s + 51] = True
        left = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in substrings.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_force(documents, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab é\n") for _ in range(300)) for _ in range(3)] + ["the cat " * 40, "x" * 200, "", "short"]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            a = r.randint(0, max(0, len(b) - 60))
            text += b[a : r.randint(a, len(b))] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 80) if r.random() < 0.5 else 0))
        docs.append((i, text))
    docs += [(100, docs[3][1]), (101, docs[5][1]), (102, docs[5][1] + "q"), (103, None), (None, base[0]), (7, base[1] * 2), (7, base[1] * 2), (7, base[0] + "tail")]
    assert result(documents(docs)) == by_force([(i, (t or "").encode()) for i, t in docs])


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "PLACE_BITS", np.uint64(11))
    monkeypatch.setattr(substrings, "BUFFER", 1 << 10)
    r = random.Random(3)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    starts = [o + (first - p[t], last - p[t])[k] for raw, p, _, offset in substrings.pieces([text, b"", b"z" * 60]) for s in [substrings.Stretches(raw, p)] for t, first, last, o in zip(s.text, s.first, s.last, offset[s.text], strict=True) for k in (0, 1)]
    assert max(starts) == 4950 and min(starts) == 0


def test_ranks_name_strings():
    raw = np.frombuffer(bytes(random.Random(4).choice(b"ab") for _ in range(400)), np.uint8)
    for length in (1, 2, 3, 6):
        names = substrings.ranks(raw, length)
        seen = {}
        assert len(names) == 400 - length + 1
        assert all(seen.setdefault(raw[i : i + length].tobytes(), n) == n for i, n in enumerate(names)) and len(set(seen.values())) == len(seen)


def test_odd_rows(documents, odd):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    assert result(odd) == by_force(rows)
    assert result(documents([])) == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.queries()["op8_substrings"](spark, sf_dir).collect()), key=repr) == by_force(rows)
