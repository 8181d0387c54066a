import itertools

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A function of rows (doc_id, text[, lang[, source]]) that makes a table of documents."""

    def make(rows, partitions=3):
        filled = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(filled, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and long texts, repeated rows, shared ids and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [(1, None), (None, "a text without an id"), (2, ""), (3, base), (3, base), (4, base.upper()), (5, base * 300, "en", "s0"), (6, "short", None, "s0"), (7, base + "é ü 你好 \U0001f600", "de", "s1"), (7, "another text of the same id", "de", "s1"), (None, None)]
    extra = ["score", "toxic", "epoch", "block", "at", "w", "h", "hits", "bits", "sha", "component_id", "found_id", "hit_id", "place", "mix_source", "s", "b", "least_id", "covered", "rank"]
    return documents(rows).withColumns(dict(zip(extra, itertools.repeat(F.lit("clash")))))
