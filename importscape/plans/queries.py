"""The registered queries of the dependency-graph operators."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import analyzers, graph, imports, shapes
from ..session import ship
from ..sources import files
from ..streaming import incremental
from . import fixtures
from . import graph as plans

#: Of the generated modules: a folder, a narrower one, and a name for one file.
ALIASES = [imports.Alias("@mod/", "src", "one.json", True), imports.Alias("@mod/large/", "src/large", "one.json", True), imports.Alias("@boot", "src/main.ts", "one.json", False)]
TARGET = 2


def corpus(spark: SparkSession, sf_dir: str) -> plans.Graph:
    return plans.build(fixtures.sources(spark, sf_dir))


def small(spark: SparkSession, sf_dir: str) -> plans.Graph:
    return plans.build(fixtures.small_sources(spark, sf_dir))


def small_path(spark: SparkSession, sf_dir: str, k: int) -> str:
    return fixtures.small_modules(spark, sf_dir).where(F.col("k") == k).first().path


def import_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.occurrences(fixtures.sources(spark, sf_dir)).select("path", F.col("pos").cast("long").alias("pos"), "raw_import", "import_nature")


def href_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The technique of the import scan, on the links of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).edges.select("source", "target")


def edge_natures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).edges


def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imports.unresolved(corpus(spark, sf_dir).resolved)
    return found.select("importer", "raw_import", F.size("attempted").cast("long").alias("n_attempted"), F.get("attempted", F.lit(1)).alias("second_attempt"))


def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.external(corpus(spark, sf_dir).resolved)


def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.edge_resolution(corpus(spark, sf_dir).resolved)


def resolved_import_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return imports.import_lists(g.resolved, g.nodes).select("path", F.array_join("targets", ",").alias("targets"))


def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).nodes.select("path", "fan_in", "fan_out")


def node_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.node_metadata(fixtures.sources(spark, sf_dir))


def http_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.topology(corpus(spark, sf_dir), "src")[0]


def node_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = plans.topology(corpus(spark, sf_dir))[0]
    return nodes.groupBy(code.badge("type").alias("badge")).agg(F.count("*").alias("n"))


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sources(spark, sf_dir).select("path", code.label("path", "content").alias("label"))


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generated module is imported by an alias: as it is, over a detour, under a name that is missing, or by the name of the main file."""
    made, k = fixtures.modules(spark, sf_dir), F.col("k")
    below = F.substr("base", F.lit(5))  # after src/
    raw = F.when(k % 4 == 0, F.concat(F.lit("@mod/"), below)).when(k % 4 == 1, F.concat(F.lit("@mod/x/../"), below)).when(k % 4 == 2, F.concat(F.lit("@mod/large/gone"), k)).otherwise(F.when(k % 8 == 3, "@boot").otherwise("@bootstrap"))
    found = made.select("path", F.lit(0).alias("pos"), raw.alias("raw_import"), F.lit("import ").alias("statement"), F.lit("runtime").alias("import_nature"))
    return imports.classified(found, made.select("path"), ALIASES).select("path", "raw_import", "kind", "target", F.size("attempted").cast("long").alias("n_attempted"), "reason")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated modules, with barrels in two of their folders."""
    barrels = spark.createDataFrame([("src/medium/index.ts",), ("src/large/index.ts",), ("src/large/public-api.ts",)], "path string")
    return graph.boundaries(fixtures.modules(spark, sf_dir).select("path").union(barrels), "src")


def boundary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = graph.boundary_lists(boundaries(spark, sf_dir))
    return lists.select("boundary", "barrel", F.size("files").cast("long").alias("n_files"), F.get("files", F.lit(0)).alias("first_file"))


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.summary(corpus(spark, sf_dir))


def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.node_stats(*plans.topology(corpus(spark, sf_dir)))


def filtered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.filtered(plans.topology(corpus(spark, sf_dir))[0], "Service", " LARGE/p1 ")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(corpus(spark, sf_dir).edges, "src/main.ts")


def impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each seventh generated module needs."""
    seeds = fixtures.modules(spark, sf_dir).where(F.col("k") % 7 == 0).select("path")
    return graph.closure(corpus(spark, sf_dir).edges, seeds).select("seed", "path")


def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = corpus(spark, sf_dir).edges
    seed = spark.createDataFrame([("src/main.ts",)], "path string")
    return graph.closure(edges, seed, reverse=True).where("path <> seed").select("path")


def trade_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixtures.trade(spark, sf_dir)
    return graph.closure(edges, edges.select(F.col("source").alias("path"))).select("seed", "path")


def impact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impact of one file of the small graph; lists are joined, the advice is in ``cut_advice``."""
    record = plans.impact(small(spark, sf_dir), small_path(spark, sf_dir, TARGET))
    advice = F.col("cycle_break_advisory")
    cuts = F.array_join(F.transform(advice["recommended_cuts"], lambda c: F.concat_ws(" ", c.source, c.target, c.strategy)), ",")
    flat = record.withColumns({"total_cycles": advice["total_cycles"], "total_cuts_required": advice["total_cuts_required"], "all_cycles_resolvable": advice["all_cycles_resolvable"], "cuts": cuts}).drop("cycle_break_advisory")
    return flat.withColumns({c: F.array_join(c, ",") for c, t in flat.dtypes if t.startswith("array")})


def impact_from_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of a file, with the paths of its nested impact from a root; absolute paths come from there."""
    g = small(spark, sf_dir)
    target = small_path(spark, sf_dir, TARGET)
    above = lambda c: F.concat(F.lit("/w/"), c)
    nested = F.col("impact")
    nested = nested.withField("target", above(nested["target"])).withField("downstream", F.transform(nested["downstream"], above))
    record = plans.from_root(plans.brief(g, target).withColumn("impact", nested), "/w")
    return record.select("path", "node_type", "fan_in", F.col("impact.target").alias("target"), F.array_join("impact.downstream", ",").alias("downstream"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.outline(corpus(spark, sf_dir), "src/main.ts").select("type_name", F.array_join("props", ",").alias("props"))


def default_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = plans.topology(corpus(spark, sf_dir))[0]
    return plans.default_node(nodes, "src/server.ts").unionByName(plans.default_node(nodes, "src/none.ts"))


def cycle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file on a cycle of the small graph with its component, named by its greatest file."""
    return graph.on_cycles(small(spark, sf_dir).edges).select("path", "component")


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.on_cycles(corpus(spark, sf_dir).edges).select("path")


def simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of the small graph; complete says that no walk was left at the length bound."""
    cycles, walks_left = graph.simple_cycles(small(spark, sf_dir).edges)
    return cycles.select(F.array_join("cycle", " > ").alias("cycle"), F.lit(not walks_left).alias("complete"))


def cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link back for each edge between the first nations of the small graph, on top of all its edges: inferential by even sources."""
    made = fixtures.small_modules(spark, sf_dir)
    ends = lambda c: made.select(F.col("path").alias(c), F.col("k").alias(f"{c}_k"))
    edges = small(spark, sf_dir).edges.select("source", "target")
    back = edges.join(ends("source"), "source").join(ends("target"), "target")
    asked = back.select((F.col("source_k") * 25 + F.col("target_k")).cast("int").alias("op_seq"), F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("source_k") % 2 == 0, "inferential").otherwise("related").alias("kind"))
    lone = made.where("k in (0, 9, 21, 23)").select((F.lit(1000) + F.col("k")).cast("int"), "path", F.lit("src/new.ts"), F.lit("inferential"))
    return graph.guarded_links(spark, asked.union(lone), edges).select(F.col("op_seq").cast("long").alias("op_seq"), "source", "target", "kind", "accepted")


def cut_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir).kept()
    types = shapes.declared(g.sources).select(F.col("path").alias("target"), F.col("type_name").alias("symbol"))
    cuts = analyzers.cut_advice(graph.simple_cycles(g.edges)[0], g.nodes, imports.usages(g.resolved, g.sources), types)
    return cuts.select("source", "target", "strategy", F.col("cut_cost").cast("long").alias("cut_cost"), "effort", "cycles_eliminated", F.array_join("symbols_involved", ",").alias("symbols"), "suggested_leaf", F.size("actionable_steps").cast("long").alias("n_steps"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return analyzers.orphans(g.nodes, g.edges).select("file", "type", "severity", "fan_in", "fan_out")


def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return analyzers.entrypoints(g.nodes, g.edges).select("file", "severity", "entrypoint_kind", "confidence", "fan_in", "fan_out")


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return analyzers.summary(analyzers.run(g.nodes, g.edges)[0])


def analyzer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return analyzers.envelope(g.nodes, g.edges).withColumn("errors", F.array_join("errors", ","))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.diagnostics(corpus(spark, sf_dir))


def semantic_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return imports.usages(g.resolved, g.sources)


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small(spark, sf_dir)
    return imports.usage_lines(imports.usages(g.resolved, g.sources))


def type_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.type_shapes(fixtures.sources(spark, sf_dir)).select("path", "type_name", F.array_join("props", ",").alias("props"))


def united_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.united(shapes.declared(fixtures.sources(spark, sf_dir))).select("type_name", F.array_join("props", ",").alias("props"))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the generated modules: every 7th is new, every 11th gone, every 13th changed."""
    k = F.col("k")
    made = fixtures.modules(spark, sf_dir).select("k", "path", F.length("path").cast("long").alias("size"), (k * 1000).alias("mtime_ns"), (k * 1000 + 1).alias("ctime_ns"))
    return made.where(k % 7 != 0), made.where(k % 11 != 0).withColumn("mtime_ns", F.when(k % 13 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest_diff(*manifests(spark, sf_dir))


def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_status(manifest_diff(spark, sf_dir))


def graph_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.signature(corpus(spark, sf_dir))


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The small graph's files (25) as a tree on disk, with files that no scan may see; the folder that holds its root ``src``."""
    top = tempfile.mkdtemp(prefix="tree-")
    extra = [("src/node_modules/x.ts", ""), ("src/.hidden/x.ts", ""), ("src/types.d.ts", ""), ("src/notes.md", ""), ("tsconfig.json", '{\n // rules\n "compilerOptions": { "baseUrl": ".", "paths": { "@z/*": ["src/*"], "@z/z0/*": ["src/z0/*"], "@main": ["src/z2/main.ts"], }, }, }')]
    for path, content in [tuple(r) for r in fixtures.small_sources(spark, sf_dir).collect()] + extra:
        os.makedirs(os.path.dirname(os.path.join(top, path)), exist_ok=True)
        with open(os.path.join(top, path), "w", encoding="utf-8") as f:
            f.write(content)
    return top


def tree_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = written_tree(spark, sf_dir)
    return files.discover(spark, f"{top}/src").select(F.substr("path", F.lit(len(top) + 2)).alias("path"), "size", (F.col("mtime_ns") > 0).alias("stamped"))


def tree_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.read_tree(spark, f"{written_tree(spark, sf_dir)}/src", keep_root=False)
    return read.select(F.concat(F.lit("src/"), "path").alias("path"), F.length("content").cast("long").alias("n_chars"))


def tree_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a tree's configuration gives, in the order in which they are tried."""
    top = written_tree(spark, sf_dir)
    rules = imports.ordered([r for r in files.find_aliases(f"{top}/src") if r.source.startswith(top)])
    return spark.createDataFrame([(i, r.pattern, r.target.removeprefix(f"{top}/"), r.wildcard) for i, r in enumerate(rules)], "ord long, pattern string, target string, wildcard boolean")


def snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small graph from a snapshot in which odd files have lost their content but kept their imports, and some records are broken."""
    found = imports.occurrences(fixtures.small_sources(spark, sf_dir)).groupBy("path").agg(F.collect_list("raw_import").alias("imports"))
    made = fixtures.small_sources(spark, sf_dir).join(found, "path", "left").join(fixtures.small_modules(spark, sf_dir).select("path", "k"), "path")
    kept = made.select("path", F.when(F.col("k") % 2 == 0, F.col("content")).otherwise("").alias("content"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))
    broken = spark.createDataFrame([(None, "import './x'", []), ("src/broken.ts", None, None)], "path string, content string, imports array<string>")
    sources, stored_imports = files.from_snapshot(kept.union(broken))
    return plans.build(sources, stored_imports=stored_imports).edges.select("source", "target", "import_nature")


def graph_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small graph written as one JSON document and read back: its version and how much is in it."""
    path = os.path.join(tempfile.mkdtemp(prefix="document-"), "graph.json")
    frames, facts = plans.document(small(spark, sf_dir))
    files.write_document(spark, frames, facts, path)
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    stamped = whole["scan_timestamp"].endswith("Z")
    counts = {k: len(v) for k, v in whole.items() if isinstance(v, list)}
    return spark.createDataFrame([(whole["schema_version"], stamped, *[counts[k] for k in ("vertices", "edges", "boundaries", "type_shapes")], whole["summary"][0]["edges"])], "schema_version string, stamped boolean, vertices long, edges long, boundaries long, type_shapes long, summary_edges long")


def topology_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topology of the small graph written as one document and read by Spark: the edges between nodes that it lists."""
    path = os.path.join(tempfile.mkdtemp(prefix="topology-"), "topology.json")
    nodes, edges = plans.topology(small(spark, sf_dir))
    files.write_document(spark, {"nodes": nodes, "edges": edges}, {}, path)
    read_nodes, read_edges = files.read_topology(spark, path)
    listed = read_nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    return read_edges.join(listed, "source").select("source", "target", "source_type")


ALL = (
    import_occurrences, href_occurrences, resolved_edges, edge_natures, unresolved_imports, external_imports, edge_resolution, resolved_import_lists, fan_in_out, node_metadata,
    http_node_types, node_badges, node_labels, alias_resolution, boundaries, boundary_lists, graph_summary, diagnostics, node_stats, filtered_nodes, neighbours, default_node,
    impact_upstream, impact_downstream, trade_closure, impact_record, impact_from_root, outline, cycle_members, cycle_components, simple_cycles, cycle_guard, cut_advice, orphans,
    entrypoints, findings_summary, analyzer_envelope, semantic_usages, usage_lines, type_shapes, united_shapes, manifest_diff, cache_status, graph_signature, tree_manifest,
    tree_sources, tree_aliases, snapshot_edges, graph_document, topology_document,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in ALL}
