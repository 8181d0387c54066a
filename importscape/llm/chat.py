"""Chat formatting by a prefix tree of turns.

A turn is written as ``### role: text </turn>`` and a newline. Inside texts, ``\\``,
``###`` and ``</turn>`` get a backslash in front, inside roles ``\\`` and ``:`` do, so
a formatted conversation reads back to just what it was made of. The loss mask of a
turn is the span of its text if its role is ``assistant``, else empty.

Conversations that begin with the same turns share the nodes of a prefix tree. A
node's name is a 128-bit digest of its parent's name and its own turn; conversations
are put in the order of their names, which makes the order in which nodes first
appear a depth-first one. Each node's characters are written once, at ``start`` in
that order, with the position its first character has in its conversation, and the
stretches of the output that it may attend to: those of its ancestors, adjacent ones
joined. A conversation is the list of its nodes' starts.

A first turn or a whole conversation that very many share is aggregated before it is
shuffled and written once. Starts come from the order of a range-partitioned sort and
the sums of its partitions; only those sums are brought together.

Defined results: turns are ordered by turn, role and text; null roles and texts are
empty; rows with a null conv_id are one conversation; repeated rows are turns of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, looked_up, stored

CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
ROLE_CONTROL, ROLE_ESCAPED = re.compile(r"[\\:]"), re.compile(r"\\([\\:])")
TURN = re.compile(r"### ((?:[^\\:]++|\\[\\:])*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")
LEARNED = "assistant"


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and its loss mask [from, to)."""
    head = "### " + ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + ": "
    body = escaped(text)
    learned = (len(head), len(head) + len(body)) if role == LEARNED else (0, 0)
    return f"{head}{body} </turn>\n", *learned


def parsed(conversation: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises if anything is left over."""
    out, at = [], 0
    while at < len(conversation):
        m = TURN.match(conversation, at)
        if m is None or not m[2].endswith(" "):
            raise ValueError(f"no turn at {at}")
        out.append((ROLE_ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2][:-1])))
        at = m.end()
    return out


def named(turns: DataFrame) -> DataFrame:
    """(conv_id, chain, leaf, nodes) for each conversation: the names of its nodes, the last, and the nodes themselves."""
    node = "struct<name:binary,depth:int,position:long,length:int,role:string,formatted:string,loss_from:int,loss_to:int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chains, all_nodes = [], []
            for rows in batch.rows:
                name, position, nodes = b"", 0, []
                for depth, row in enumerate(rows):
                    text, a, b = formatted(row["role"], row["text"])
                    name = hashlib.blake2b(name + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    nodes.append({"name": name, "depth": depth, "position": position, "length": len(text), "role": row["role"], "formatted": text, "loss_from": a, "loss_to": b})
                    position += len(text)
                chains.append(b"".join(n["name"] for n in nodes))
                all_nodes.append(nodes)
            yield pd.DataFrame({"conv_id": batch.conv_id.astype("Int64"), "chain": chains, "leaf": [c[-16:] for c in chains], "nodes": all_nodes})

    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    slim = grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("rows"))
    return slim.mapInPandas(run, f"conv_id long, chain binary, leaf binary, nodes array<{node}>")


def write(turns: DataFrame, out_dir: str | None = None) -> str:
    """Formats conversations (conv_id, turn, role, text) into two Parquet tables under the folder that is returned.

    ``nodes``: start, length, position, role, formatted, loss_from, loss_to, attends
    (array of from, to). ``conversations``: conv_id, starts (of its nodes, in order).
    """
    spark = turns.sparkSession
    out = out_dir or fresh_dir(spark, "chat")
    convs = stored(named(turns))
    distinct = stored(convs.select("chain", "leaf", "nodes").dropDuplicates(["leaf"]))
    paths = distinct.select("chain", "leaf").repartitionByRange("chain").sortWithinPartitions("chain")
    ranked = stored(paths.select("leaf", F.monotonically_increasing_id().alias("rank")))
    steps = distinct.join(ranked, "leaf").select("rank", F.explode("nodes").alias("n")).select("rank", "n.*")
    nodes = steps.groupBy("name").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("depth", "position", "length", "role", "formatted", "loss_from", "loss_to")])
    ordered = nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth").withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("part", F.shiftright("place", 33)))
    sums = ordered.groupBy("part").agg(F.sum("length").alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    running = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(ordered.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("length").over(running), F.lit(0))).drop("before", "part", "place"))

    # each path once: where its nodes are, then, for the nodes that it is the first to hold, what they attend to
    walks = distinct.join(ranked, "leaf").select("leaf", F.col("rank").alias("walk"), F.explode("nodes.name").alias("name"))
    spots = looked_up(walks, placed.select("name", "start", "length", "depth", "rank"), "name").groupBy("leaf", "walk").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "length", "rank"))).alias("spots"))
    spots = stored(spots)

    def attending(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for walk, found in zip(batch.walk, batch.spots, strict=True):
                joined: list[list[int]] = []
                for s in found:
                    if s["rank"] == walk:
                        rows.append((s["start"], [{"from": a, "to": b} for a, b in joined]))
                    if joined and joined[-1][1] == s["start"]:
                        joined[-1][1] += s["length"]
                    else:
                        joined.append([s["start"], s["start"] + s["length"]])
            yield pd.DataFrame(rows, columns=["start", "attends"])

    attends = spots.select("walk", "spots").mapInPandas(attending, "start long, attends array<struct<from:long,to:long>>")
    placed.join(attends, "start").select("start", "length", "position", "role", "formatted", "loss_from", "loss_to", "attends").write.parquet(f"{out}/nodes")
    lists = spots.select("leaf", F.transform("spots", lambda s: s.start).alias("starts"))
    looked_up(convs.select("conv_id", "leaf"), lists, "leaf").select("conv_id", "starts").write.parquet(f"{out}/conversations")
    return out


def read(spark, out: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the conversations in a written folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for leaf, parts in zip(batch.leaf, batch.parts, strict=True):
                text = "".join(p["formatted"] for p in parts)
                turns = parsed(text)
                learned = "".join(ESCAPED.sub(r"\1", p["formatted"][p["loss_from"] : p["loss_to"]]) for p in parts)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                rows.append((leaf, len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    nodes = spark.read.parquet(f"{out}/nodes").select("start", "position", "formatted", "loss_from", "loss_to")
    # a conversation's last node names it
    convs = spark.read.parquet(f"{out}/conversations").withColumn("leaf", F.element_at("starts", -1))
    paths = convs.groupBy("leaf").agg(F.first("starts").alias("starts")).select("leaf", F.explode("starts").alias("start"))
    parts = paths.join(nodes, "start").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("position", "formatted", "loss_from", "loss_to"))).alias("parts"))
    digests = parts.mapInPandas(run, "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return looked_up(convs.select("conv_id", "leaf"), digests, "leaf").drop("leaf")
