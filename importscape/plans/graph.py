"""The built graph and its views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import analyzers, graph, imports, shapes
from ..session import stored

SCHEMA_VERSION = "1.0.0"


@dataclass(frozen=True)
class Graph:
    """Lazy frames of a corpus; nothing is computed before it is asked for."""

    sources: DataFrame
    resolved: DataFrame
    edges: DataFrame
    nodes: DataFrame
    alias_rules: int = 0

    def kept(self) -> Graph:
        """The graph with its resolved imports computed once; all that comes from them reads what is stored."""
        return over(self.sources, stored(self.resolved), self.alias_rules)

    def bounds(self, root: str = ".") -> DataFrame:
        return graph.boundaries(self.nodes, root)


def node_metadata(sources: DataFrame) -> DataFrame:
    """(path, node_type, is_entrypoint, entrypoint_kind, entrypoint_confidence, is_test)."""
    found = sources.select("path", paths.node_type("path", "content").alias("node_type"), paths.entrypoint("path").alias("e"), paths.is_test("path").alias("is_test"))
    return found.select("path", "node_type", F.col("e.is_entrypoint").alias("is_entrypoint"), F.col("e.kind").alias("entrypoint_kind"), F.col("e.confidence").alias("entrypoint_confidence"), "is_test")


def build(sources: DataFrame, rules: list[imports.Alias] | None = None, stored_imports: DataFrame | None = None) -> Graph:
    """sources: path, content. stored_imports: occurrences that stand in for files without content."""
    found = imports.occurrences(sources)
    if stored_imports is not None:
        found = found.unionByName(stored_imports)
    return over(sources, imports.classified(found, sources, rules), len(rules or []))


def over(sources: DataFrame, resolved: DataFrame, alias_rules: int = 0) -> Graph:
    edges = imports.edges(resolved)
    return Graph(sources, resolved, edges, graph.fans(node_metadata(sources), edges), alias_rules)


def in_one_row(*parts: DataFrame) -> DataFrame:
    """The columns of frames that have one row each."""
    one = F.lit(1).alias("one")
    whole = parts[0].select("*", one)
    for p in parts[1:]:
        whole = whole.join(F.broadcast(p.select("*", one)), "one")
    return whole.drop("one")


def summary(g: Graph) -> DataFrame:
    """One row of counts."""
    n, g = (lambda cond: F.count_if(cond).cast("long")), g.kept()
    nodes = g.nodes.agg(F.count("*").alias("files"), n(F.col("is_entrypoint")).alias("entrypoints"), n(F.col("is_test")).alias("tests"), n(F.col("fan_in") == 0).alias("unreferenced"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    edges = g.edges.agg(F.count("*").alias("edges"), n(F.col("import_nature") == "runtime").alias("runtime_edges"), n(F.col("import_nature") == "type_only").alias("type_only_edges"))
    kinds = g.resolved.agg(*[n(F.col("kind") == k).alias(f"{k}_imports") for k in ("resolved", "unresolved", "external")])
    bounds = g.bounds().agg(F.count_distinct("boundary").alias("boundaries"))
    types = shapes.counted(g.sources)
    return in_one_row(nodes, edges, kinds, bounds, types).withColumn("alias_rules", F.lit(g.alias_rules).cast("long"))


def diagnostics(g: Graph) -> DataFrame:
    """One row: unresolved and external imports, files that could not be read (content null), imports that several aliases resolve differently, unreferenced files."""
    n, g = (lambda cond: F.count_if(cond).cast("long")), g.kept()
    kinds = g.resolved.agg(n(F.col("kind") == "unresolved").alias("unresolved_imports"), n(F.col("kind") == "external").alias("external_imports"))
    read = g.sources.agg(n(F.col("content").isNull()).alias("skipped_files"))
    # ambiguous: more than one of the attempted candidates is a file
    files = g.nodes.select(F.col("path").alias("candidate"))
    tried = g.resolved.where("kind = 'resolved'").select("path", "pos", F.explode("attempted").alias("candidate"))
    several = tried.join(files, "candidate", "left_semi").groupBy("path", "pos").count().where("count > 1").agg(F.count("*").alias("ambiguous_resolutions"))
    lone = g.nodes.agg(n(F.col("fan_in") == 0).alias("unreferenced_files"))
    return in_one_row(kinds, read, several, lone)


def topology(g: Graph, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, path, label, type; edges: source, target), paths from root."""
    shown = lambda c: paths.relative_to(root, c) if root else F.col(c)
    nodes = g.nodes.select(shown("path").alias("path"))
    return nodes.select(F.col("path").alias("id"), "path", paths.basename("path").alias("label"), paths.topology_type("path").alias("type")), g.edges.select(shown("source").alias("source"), shown("target").alias("target"))


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes there are, of each type, and how many edges."""
    counted = nodes.agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).cast("long").alias(t.lower()) for t in ("Service", "Component", "Module", "Helper", "Other")])
    return in_one_row(counted, edges.agg(F.count("*").alias("edges")))


def filtered(nodes: DataFrame, kind: str = "ALL", text: str = "") -> DataFrame:
    """Nodes of a type that hold a text in path, label or type, whatever its case."""
    found = nodes if kind == "ALL" else nodes.where(F.col("type") == kind)
    wanted = text.strip().lower()
    return found.where(F.contains(F.lower("path"), F.lit(wanted)) | F.contains(F.lower("label"), F.lit(wanted)) | F.contains(F.lower("type"), F.lit(wanted))) if wanted else found


def default_node(nodes: DataFrame, preferred: str) -> DataFrame:
    """The preferred node if there is one, else the first by path."""
    return nodes.orderBy(F.col("path") != preferred, "path").limit(1)


def cycle_break(g: Graph, sets: DataFrame, target: str, longest: int = 12) -> DataFrame:
    """One row: the simple cycles through a target and where to cut them; walks_left says whether cycles longer than ``longest`` may exist."""
    both = sets.where("relation = 'upstream'").select("path").intersect(sets.where("relation = 'downstream'").select("path"))
    ring = stored(both.union(g.nodes.sparkSession.createDataFrame([(target,)], "path string")))
    inside = g.edges.select("source", "target").join(ring.toDF("source"), "source", "left_semi").join(ring.toDF("target"), "target", "left_semi")
    cycles, walks_left = graph.simple_cycles(inside, longest)
    own = cycles.where(F.array_contains("cycle", target))
    sources = g.sources.join(ring, "path", "left_semi")
    used = imports.usages(g.resolved.join(ring.toDF("target"), "target", "left_semi"), sources)
    types = shapes.declared(sources).select(F.col("path").alias("target"), F.col("type_name").alias("symbol"))
    cuts = analyzers.cut_advice(own, g.nodes, used, types)
    made = cuts.agg(F.sort_array(F.collect_list(F.struct("cut_cost", "source", "target", "strategy", "effort", "cycles_eliminated", "symbols_involved", "suggested_leaf", "rationale", "actionable_steps"))).alias("cuts"))
    return in_one_row(own.agg(F.count("*").alias("total_cycles")), made).select(
        F.struct("total_cycles", F.size("cuts").cast("long").alias("total_cuts_required"), F.lit(not walks_left).alias("all_cycles_resolvable"), F.lit(walks_left).alias("walks_left"), F.col("cuts").alias("recommended_cuts")).alias("cycle_break_advisory")
    )


def impact(g: Graph, target: str) -> DataFrame:
    """One row on a file: what it needs and what needs it, who uses what of it, cycles through it and where to cut them, entry points it reaches, its risk.

    The lists are arrays of one row: a file that all others reach makes them as long as
    the graph has files. ``graph.impact_sets`` gives the same as rows.
    """
    g = g.kept()
    sets = stored(graph.impact_sets(g.edges, target))
    pick = lambda name: F.sort_array(F.collect_set(F.when(F.col("relation") == name, F.col("path")))).alias(name)
    names = ("upstream", "downstream", "direct_upstream", "direct_downstream")
    lists = sets.agg(*[pick(n) for n in names])
    loops = g.edges.where((F.col("source") == target) & (F.col("target") == target)).agg((F.count("*") > 0).alias("self"))
    starts = sets.where("relation = 'downstream'").join(g.nodes.where("is_entrypoint").select("path"), "path", "left_semi").agg(F.sort_array(F.collect_set("path")).alias("affected_entrypoints"))
    own = g.nodes.where(F.col("path") == target).agg(
        (F.count("*") > 0).alias("exists"), F.coalesce(F.first("is_entrypoint"), F.lit(False)).alias("target_is_entrypoint"), F.coalesce(F.first("is_test"), F.lit(False)).alias("target_is_test"),
        F.coalesce(F.first("fan_in"), F.lit(0)).alias("target_fan_in"), F.coalesce(F.first("fan_out"), F.lit(0)).alias("target_fan_out"),
    )
    lines = imports.usage_lines(imports.usages(g.resolved.where(F.col("target") == target), g.sources)).agg(F.sort_array(F.collect_set("line")).alias("semantic_usages"))
    whole = in_one_row(lists, loops, starts, own, lines, cycle_break(g, sets, target))
    risk = graph.risk(F.col("target_fan_in"))
    on_cycle = F.arrays_overlap("upstream", "downstream") | F.col("self")
    circular = F.when(on_cycle, F.array(F.lit(target))).otherwise(F.array().cast("array<string>"))
    return whole.select(
        F.lit(target).alias("target"), "exists", *names, "semantic_usages", circular.alias("circular_references"), "cycle_break_advisory", "affected_entrypoints", "target_is_entrypoint", "target_is_test",
        "target_fan_in", "target_fan_out", risk["level"].alias("change_risk_level"), risk["reasons"].alias("change_risk_reasons"),
        F.size("upstream").cast("long").alias("upstream_count"), F.size("downstream").cast("long").alias("downstream_count"),
    )


SCALAR_PATHS, LIST_PATHS = ("target", "file", "requested_target"), ("upstream", "downstream", "direct_upstream", "direct_downstream", "affected_entrypoints", "circular_references", "candidate_targets")


def from_root(record: DataFrame, root: str) -> DataFrame:
    """An impact record (or one nested as ``impact``) with its paths from root; other columns pass."""

    def shown(name: str, value: Column) -> Column | None:
        if name in SCALAR_PATHS:
            return F.when(F.startswith(value, F.lit("/")), paths.relative_to(root, value)).otherwise(value)
        return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: paths.relative_to(root, x)) if name in LIST_PATHS else None

    made = {c: m for c in record.columns if (m := shown(c, F.col(c))) is not None}
    if "impact" in record.columns:
        nested = F.col("impact")
        for c in record.schema["impact"].dataType.names:
            if (m := shown(c, F.col("impact")[c])) is not None:
                nested = nested.withField(c, m)
        made["impact"] = nested
    return record.withColumns(made)


def brief(g: Graph, target: str) -> DataFrame:
    """Ours: a file's node row with its impact nested."""
    own = impact(g, target)
    nested = own.select(F.struct(*own.columns).alias("impact"), F.lit(target).alias("path"))
    return g.nodes.where(F.col("path") == target).join(F.broadcast(nested), "path")  # one row


def outline(g: Graph, target: str) -> DataFrame:
    """Ours: the types a file declares, with their properties."""
    return shapes.type_shapes(g.sources, target).select("type_name", "props")


def signature(g: Graph) -> DataFrame:
    """One row: a digest of the graph (nodes, edges, unresolved and external imports, boundaries, type shapes) that depends on neither the order of rows nor when they were read.

    Each row's SHA-256 goes into two sums; sums combine in any order.
    """
    g = g.kept()
    said = lambda kind, *columns: F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("row")
    frames = [
        g.nodes.withColumn("sure", F.round(F.col("entrypoint_confidence") * 100).cast("int")).select(said("node", "path", "node_type", "is_entrypoint", "entrypoint_kind", "sure", "is_test", "fan_in", "fan_out")),
        g.edges.select(said("edge", "source", "target", "import_nature")),
        imports.unresolved(g.resolved).withColumn("attempted", F.array_join("attempted", ",")).select(said("unresolved", "importer", "raw_import", "attempted", "reason")),
        imports.external(g.resolved).select(said("external", "importer", "raw_import")),
        g.bounds().select(said("boundary", "path", "boundary", "barrel")),
        shapes.type_shapes(g.sources).withColumn("props", F.array_join("props", ",")).select(said("shape", "path", "type_name", "props")),
    ]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    digests = rows.select(F.sha2("row", 256).alias("d"))
    part = lambda at: F.sum(F.conv(F.substr("d", F.lit(at), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string")
    return digests.agg(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256)).alias("signature"))


def document(g: Graph) -> tuple[dict[str, DataFrame], dict]:
    """The frames and facts of the whole graph, for ``files.write_document`` or ``files.write_graph``."""
    from datetime import UTC, datetime

    g = g.kept()
    frames = {
        "vertices": g.nodes, "edges": g.edges, "resolved_imports": imports.import_lists(g.resolved, g.nodes), "unresolved_imports": imports.unresolved(g.resolved),
        "external_imports": imports.external(g.resolved), "boundaries": graph.boundary_lists(g.bounds()), "type_shapes": shapes.type_shapes(g.sources), "summary": summary(g),
    }
    order = {"vertices": ["path"], "edges": ["source", "target"], "resolved_imports": ["path"], "unresolved_imports": ["importer", "raw_import"], "external_imports": ["importer", "raw_import"], "boundaries": ["boundary"], "type_shapes": ["path", "type_name"], "summary": []}
    sorted_ = {k: f.orderBy(*order[k]) if order[k] else f for k, f in frames.items()}
    return sorted_, {"schema_version": SCHEMA_VERSION, "scan_timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}


def runtime(spark) -> DataFrame:
    """One row on what this runs on."""
    return spark.createDataFrame([(True, "Apache Spark", spark.version, "active")], "supported boolean, runtime string, version string, status string")
