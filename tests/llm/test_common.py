import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from importscape.llm import common, queries, token_store


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1000, 20])
def test_looked_up_is_a_join(spark, monkeypatch, how, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    keys = [7] * 150 + [8] * 60 + [None] * 90 + list(range(30)) + [99, 99]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, key long").repartition(5)
    values = spark.createDataFrame([(k, f"v{k}") for k in range(25)] + [(500, "v500")], "key long, value string")
    same = lambda df: Counter(map(tuple, df.select("i", "key", "value").collect()))
    assert same(common.looked_up(rows, values, "key", how)) == same(rows.join(values, "key", how))
    assert common.looked_up(rows.where("false"), values, "key", how).count() == 0


def test_workers_forget_what_other_operators_kept():
    path = queries.tokenizer_path("word_bpe_49k.json")
    kept = token_store.encoder(path, 100)
    assert token_store.encoder(path, 100) is kept
    common.forget()
    assert token_store.encoder(path, 100) is not kept


def own_mb():
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.parametrize("run", [common.forget, lambda: list(common.tidy(iter)([]))])
def test_workers_give_free_memory_back(run):
    before = own_mb()
    pieces = [np.ones(2000, np.uint8) for _ in range(100_000)]
    last = pieces[-1]  # what lies below it stays with the process when it is freed
    del pieces
    run()
    assert own_mb() < before + 60 and last.all()


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"doc_id": [None, 3, *range(10, 1500)], "text": ["a", None, *map(str, range(10, 1500))]})
    assert list(token_store.sliced(batch, 7)) == list(zip(*batch.to_pydict().values()))
