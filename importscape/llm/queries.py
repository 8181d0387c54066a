"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat, decontaminate, extract, labelled, mixing, neighbours, quality, simhash, substrings, token_store, toxicity
from .common import table
from .oracles import OP1


def tokenizer_path(name: str) -> str:
    """A public vocabulary file of this machine; it is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, at 97 % of the entropy of equal weights and four repeats at most."""
    drawn = mixing.mixed(table(spark, sf_dir, "documents"), share_of_entropy=0.97, most_repeats=4.0, budget_of_tokens=1.0)
    return drawn.select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"), "epoch", "block", "at")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, wanted=20)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality"), threshold=0.3)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read(spark, chat.write(turns.union(extra)))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic"))
    held = labelled.held_out(F.col("doc_id")).alias("held_out")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("toxic").alias("over_threshold"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.read_shards(manifest)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_extract, op3_mixing, op4_neighbours, op5_simhash, op6_quality, op7_chat, op8_substrings, op9_toxicity, op10_token_store)
    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1}
