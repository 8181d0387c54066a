"""Named analyses over nodes (path, node_type, is_entrypoint, ..., fan_in, fan_out) and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what is said of a file that nothing imports.
ORPHAN = "File has fan_in=0, is not an entrypoint, and is not a test file."
FINDING = ("analyzer", "type", "severity", "file", "node_type", "observation", "entrypoint_kind", "confidence", "fan_in", "fan_out")


def finding(rows: DataFrame, **values) -> DataFrame:
    given = {"file": F.col("path"), "node_type": F.col("node_type"), "fan_in": F.col("fan_in"), "fan_out": F.col("fan_out")} | values
    kinds = {"confidence": "double", "fan_in": "long", "fan_out": "long"}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FINDING])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lone = nodes.where((F.col("fan_in") == 0) & ~F.col("is_entrypoint") & ~F.col("is_test"))
    return finding(lone, analyzer=F.lit("orphan"), type=F.lit("potential_orphan"), severity=F.lit("low"), observation=F.lit(ORPHAN))


def entrypoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return finding(nodes.where("is_entrypoint"), analyzer=F.lit("entrypoint"), type=F.lit("entrypoint"), severity=F.lit("info"), entrypoint_kind=F.col("entrypoint_kind"), confidence=F.col("entrypoint_confidence"))


#: Register further analyzers here: name -> function of (nodes, edges) that returns findings.
ANALYZERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"orphan": orphans, "entrypoint": entrypoints}


def run(nodes: DataFrame, edges: DataFrame, names: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The findings of all named analyzers, and the errors of those that could not be planned."""
    found, errors = None, {}
    for name in names or list(ANALYZERS):
        try:
            rows = ANALYZERS[name](nodes, edges)
            found = rows if found is None else found.unionByName(rows)
        except Exception as e:  # an analyzer's failure is part of the report
            errors[name] = f"{type(e).__name__}: {e}"
    return found, errors


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analyzer", "severity").agg(F.count("*").alias("n_findings"))


def envelope(nodes: DataFrame, edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row on a run: how many findings there are in all, how many analyzers ran and failed, and the errors (array of name: message)."""
    found, errors = run(nodes, edges, names)
    n = len(names or ANALYZERS)
    counted = (found if found is not None else nodes.limit(0)).agg(F.count("*").alias("total_findings"))
    listed = F.array(*[F.lit(f"{k}: {v}") for k, v in sorted(errors.items())]).cast("array<string>")
    return counted.select("total_findings", F.lit(n - len(errors)).cast("long").alias("analyzers_run"), F.lit(len(errors)).cast("long").alias("analyzers_failed"), listed.alias("errors"))


# Ours: layers, costs and efforts of cuts. Two strategies are known behaviour (10, trivial; 35, low); the rest is a default.
LAYERS = {"Helper": 0, "Other": 2, "Service": 3, "Component": 4, "Module": 5}
STRATEGIES = {"type_only_import": (10, "trivial"), "architectural_inversion": (35, "low"), "extract_shared": (60, "medium")}


def cut_advice(cycles: DataFrame, nodes: DataFrame, used: DataFrame, type_names: DataFrame) -> DataFrame:
    """For each cycle its cheapest edge: (source, target, strategy, cut_cost, effort, cycles_eliminated, symbols_involved, suggested_leaf, rationale, actionable_steps).

    cycles: cycle (array). used: source, target, symbol, usage. type_names: target,
    symbol of interfaces and aliases. An edge is type_only_import if all its symbols
    are only typed and are such names; else architectural_inversion if it leads to a
    higher layer; else extract_shared. Ties go to the smaller (source, target). The
    words of rationale and steps are ours.
    """
    size = F.size("cycle")
    steps = cycles.withColumn("id", F.xxhash64("cycle")).select("id", F.explode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("cycle", i).alias("source"), F.get("cycle", (i + 1) % size).alias("target")))).alias("e")).select("id", "e.*")
    marked = used.join(type_names.distinct().withColumn("is_type", F.lit(True)), ["target", "symbol"], "left")
    only_types = F.bool_and(F.startswith("usage", F.lit("typed(")) & F.coalesce("is_type", F.lit(False)))
    typed = marked.groupBy("source", "target").agg(only_types.alias("only_types"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    layer = F.coalesce(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[F.col("node_type")], F.lit(2))
    levels = nodes.select("path", layer.alias("layer"))
    edges = steps.join(typed, ["source", "target"], "left").join(levels.toDF("source", "from_layer"), "source").join(levels.toDF("target", "to_layer"), "target")
    strategy = F.when(F.coalesce("only_types", F.lit(False)), "type_only_import").when(F.col("from_layer") < F.col("to_layer"), "architectural_inversion").otherwise("extract_shared")
    of = lambda k: F.create_map(*[F.lit(x) for name, values in STRATEGIES.items() for x in (name, values[k])])[F.col("strategy")]
    symbols = F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols_involved")
    priced = edges.withColumn("strategy", strategy).withColumn("cut_cost", of(0))
    best = priced.groupBy("id").agg(F.min(F.struct("cut_cost", "source", "target", "strategy", symbols, "from_layer", "to_layer")).alias("b"))
    cuts = best.groupBy("b.source", "b.target", "b.strategy", "b.cut_cost", "b.symbols_involved", "b.from_layer", "b.to_layer").agg(F.count("*").alias("cycles_eliminated")).withColumn("effort", of(1))
    names = F.array_join("symbols_involved", ", ")
    named, typed_only, upward = F.col("strategy"), F.lit("type_only_import"), F.lit("architectural_inversion")
    stem = F.regexp_replace("target", r"\.(ts|tsx|js|jsx)\z", "")
    leaf = F.when(named == typed_only, F.concat(stem, F.lit(".types.ts"))).otherwise(F.concat(F.regexp_replace("target", r"[^/]*\z", ""), F.substring_index(F.substring_index("target", "/", -1), ".", 1), F.lit(".shared.ts")))
    why = F.when(named == typed_only, F.format_string("%s uses nothing but types (%s) of %s", "source", names, "target")).when(
        named == upward, F.format_string("%s, on layer %d, imports %s, on the higher layer %d", "source", "from_layer", "target", "to_layer")
    ).otherwise(F.format_string("%s and %s need each other on one layer or downwards", "source", "target"))
    todo = F.when(named == typed_only, F.array(F.format_string("in %s, import type { %s } from %s", "source", names, "target"))).when(
        named == upward, F.array(F.format_string("move what both need into %s", leaf), F.format_string("hand %s to %s as an argument", "target", "source"))
    ).otherwise(F.array(F.format_string("move what both need into %s", leaf)))
    return cuts.withColumns({"suggested_leaf": leaf, "rationale": why, "actionable_steps": todo}).drop("from_layer", "to_layer")
