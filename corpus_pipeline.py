"""From raw documents to token shards: each stage works on all that the one before it kept.

Each stage takes and returns the columns of documents, but for the last, which
returns what the shards hold. Nulls, empty texts, repeated rows, empty tables and
extra columns are treated as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from importscape.llm import decontaminate, mixing, queries, simhash_wide, token_store, toxicity
from importscape.llm.common import table
from importscape.session import ship


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold; the classifier learns from the labels of these documents."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.scored(docs, model).where("not toxic").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash near duplicates that share 80 % of their five-word shingles."""
    ship(spark)
    return simhash_wide.deduplicated(docs, words=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources again, twice in all at most, towards equal weights."""
    return mixing.mixed(docs, share_of_entropy=0.97, most_repeats=2.0).select(docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-id shards; one row a stored document, read back from them."""
    ship(spark)
    # fewer words remembered than by default: the workers also hold what the stages before left in them
    manifest = token_store.write_shards(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=1, cache_words=900_000)
    return token_store.read_shards(manifest)


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_output", token_shards),
]
#: Neither the classifier nor the hashed draws can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
