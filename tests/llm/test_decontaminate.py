import math
import random
import re

import pytest

from importscape.llm import decontaminate


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def by_force(docs, items):
    out = set()
    for d, t in docs:
        for i, s in items:
            both = len(shingles(t) & shingles(s))
            if shingles(s) and both >= math.ceil(0.8 * len(shingles(s)) - 1e-9):
                out.add((d, i, len(shingles(s)), both))
    return out


@pytest.mark.parametrize("literals", [50_000, 0])
def test_against_force(spark, documents, monkeypatch, literals):
    monkeypatch.setattr(decontaminate, "LITERAL_ROWS", literals)
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(1, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (93, "a a a a a a a a")]
    docs = [(i, text(r.randint(0, 50))) for i in range(40)] + [(500, "One, two!"), (501, None), (502, "x " + "a " * 9)]
    for k, (_, t) in enumerate(items[:30]):
        w = t.split()
        for cut in (0, 1, len(w) // 8, len(w) // 4):
            docs.append((1000 + 10 * k + cut, text(80) + " " + " ".join(w[cut:]).upper() + ". " + text(200)))
    found = decontaminate.contained(documents(docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id, x.n_item, x.n_shared) for x in found.collect()}
    assert got == by_force(docs, items) and len(got) > 50


def test_odd_rows(spark, odd, documents):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string")
    found = sorted(r.doc_id for r in decontaminate.contained(odd, items).collect())
    assert found == [3, 3, 4, 5, 7]
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "6", "None", "None"]
    assert decontaminate.contained(odd, items.where("false")).count() == 0
    assert decontaminate.contained(documents([]), items).count() == 0
