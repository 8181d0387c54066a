"""Mixing sources to target weights, by temperature.

A source's share of all tokens is raised to an exponent and normalised to its
weight. The exponent is bisected: to the entropy wanted, then, if a source would
be repeated more often than the limit allows, towards 1 until it is not.

Each source's budget of tokens is realised by block permutations: its documents are
hashed into blocks, each epoch walks the blocks in an order of its own, and the
walk stops within one document of the budget. ``at`` is the share of its source's
budget that lies before the block, so sorting by ``at`` interleaves the sources at
their weights from start to end.

Only one row a source reaches the driver. Blocks of a source hold about
``BLOCK_DOCS`` documents, so no task ever holds more of a hot source than that;
the schedule has one row a block and epoch.

Defined results: a null source is a source; null texts have no tokens; a source
without tokens gets one epoch; repeated rows are separate documents; an empty table
gives no rows; extra columns are kept, but for those this module adds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored

BLOCK_DOCS = 1000
#: Sources whose counts may come to the driver; more raise an error.
MOST_SOURCES = 100_000
BROADCAST_BLOCKS = 100_000
#: An epoch's order of blocks is cut into two to the power of this many stretches, at most.
STRETCH_BITS = 10
ADDED = ("epoch", "block", "at")


def tokens(text: Column) -> Column:
    """White-space-separated words of a text."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1).cast("long")


def weights_at(counts: list[float], exponent: float) -> list[float]:
    total = sum(counts)
    raw = [math.exp(exponent * math.log(c / total)) if c else 0.0 for c in counts]
    return [r / sum(raw) for r in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def bisect(low: float, high: float, above, steps: int = 100) -> float:
    """The point where above() turns from true to false between low and high."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) else (low, middle)
    return high


@dataclass
class Plan:
    """exponent; weight, budget (tokens) of each source, in the order of the counts given."""

    exponent: float
    weights: list[float]
    budgets: list[int]


def plan(counts: list[int], share_of_entropy: float, most_repeats: float, budget: int | None) -> Plan:
    """counts: tokens of each source. share_of_entropy: of the entropy of equal weights.

    budget: tokens in all; None: the fewest at which no source loses a document.
    Without a budget, repeats are counted against that; a budget over the limit
    times all tokens cannot be met and raises ValueError.
    """
    live = [c for c in counts if c]
    if not live:
        return Plan(1.0, [0.0] * len(counts), [0] * len(counts))

    def total(ws: list[float]) -> float:
        return budget if budget is not None else max(c / w for c, w in zip(live, ws, strict=True))

    def repeats(a: float) -> float:
        ws = weights_at(live, a)
        return max(w * total(ws) / c for c, w in zip(live, ws, strict=True))

    if budget is not None and budget > most_repeats * sum(live) * (1 + 1e-9):
        raise ValueError("the budget needs more repeats than the limit allows")
    wanted = share_of_entropy * math.log(len(live))
    exponent = 0.0 if entropy(weights_at(live, 0)) <= wanted or len(live) == 1 else bisect(0.0, 64.0, lambda a: entropy(weights_at(live, a)) > wanted)
    if repeats(exponent) > most_repeats * (1 + 1e-9):
        # flatter than the shares, small sources repeat too often; steeper, large ones do: 1 is even
        exponent = bisect(exponent, 1.0, lambda a: repeats(a) > most_repeats) if exponent < 1 else -bisect(-exponent, -1.0, lambda a: repeats(-a) > most_repeats)
    ws = weights_at(counts, exponent)
    whole = total(weights_at(live, exponent))
    least = counts if budget is None else [0] * len(counts)
    return Plan(exponent, ws, [max(m, round(w * whole)) for m, w in zip(least, ws, strict=True)])


def mixed(docs: DataFrame, share_of_entropy: float = 0.97, most_repeats: float = 4.0, budget: int | None = None, budget_of_tokens: float | None = None, seed: int = 7, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), as often as drawn, with epoch, block and at.

    budget: tokens in all, or budget_of_tokens: that many times the tokens there
    are; neither: the fewest at which every document is drawn at least once.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    small = stored(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("n_tokens")))
    counted = small.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counted.sort(key=lambda r: (r.source is not None, r.source or ""))
    if budget is None and budget_of_tokens is not None:
        budget = round(budget_of_tokens * sum(r.n_tokens for r in counted))
    made = plan([r.n_tokens for r in counted], share_of_entropy, most_repeats, budget)
    rows = [(r.source, r.n_tokens, math.ceil(r.n_docs / block_docs), b, max(1, math.ceil(b / r.n_tokens)) if r.n_tokens else 1) for r, b in zip(counted, made.budgets, strict=True)]
    sources = F.broadcast(spark.createDataFrame(rows, "mix_source string, mix_tokens long, mix_blocks int, mix_budget long, mix_epochs int"))  # at most MOST_SOURCES rows

    def blocked(df: DataFrame) -> DataFrame:
        joined = df.join(sources, df.source.eqNullSafe(F.col("mix_source")))
        return joined.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.col("mix_blocks")).cast("int"))

    blocks = blocked(small).groupBy("mix_source", "mix_tokens", "mix_budget", "mix_epochs", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    # where each block starts in its epoch's order: the order is cut into stretches, which are summed first, so that no task orders all blocks of a source
    order = F.xxhash64(F.lit(seed), "mix_source", "epoch", "block")
    walked = stored(blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("mix_epochs") - 1))).withColumn("order", order).withColumn("stretch", F.shiftright("order", 64 - STRETCH_BITS)))
    before = Window.partitionBy("mix_source", "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    cut = ["mix_source", "epoch", "stretch"]
    sums = walked.groupBy(cut).agg(F.sum("block_tokens").alias("s"))
    stretches = sums.select(F.struct(cut).alias("cut"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(cut).orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    walked = walked.withColumn("inside", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))).withColumn("cut", F.struct(cut)).join(stretches, "cut").drop("cut")
    start = F.col("epoch") * F.col("mix_tokens") + F.col("before") + F.col("inside")
    schedule = walked.withColumn("start", start).where("start < mix_budget or mix_tokens = 0")
    schedule = stored(schedule.select("mix_source", "block", "epoch", (F.col("mix_budget") - F.col("start")).alias("left"), F.coalesce(F.try_divide("start", "mix_budget"), F.lit(0.0)).alias("at"), (F.col("start") + F.col("block_tokens") > F.col("mix_budget")).alias("cut")))
    schedule = hinted(schedule.select(F.col("mix_source").alias("s"), F.col("block").alias("b"), "epoch", "left", "at", "cut"), schedule.count(), BROADCAST_BLOCKS)

    # a document's own columns travel as one, so that none can clash with those made here
    placed = blocked(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"), "source", "doc_id", "text"))
    drawn = placed.join(schedule, placed.mix_source.eqNullSafe(F.col("s")) & (placed.block == F.col("b")))
    kept = ["mix_row.*", "epoch", "block", "at"]
    whole = drawn.where("not cut").select(kept)
    # at most one block of a source is cut: its documents are walked in hash order up to the budget
    inner = Window.partitionBy("mix_source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", F.col("doc_id").cast("long")), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.where("cut").withColumn("mix_before", F.coalesce(F.sum(tokens(F.col("text"))).over(inner), F.lit(0)))
    return whole.union(parts.where(F.col("mix_before") < F.col("left")).select(kept))
