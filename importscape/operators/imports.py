"""From sources (path, content) to resolved, unresolved and external imports, and edges.

Everything is a narrow projection up to one join of candidate paths with the files
there are, and one aggregation by occurrence; Catalyst plans both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code, paths


#: Fixed value: why an import that an alias fits is not resolved.
ALIAS_MISSED = "alias_candidate_not_found"


@dataclass(frozen=True)
class Alias:
    """An alias of the configuration: an exact name, or a prefix whose rest is appended to the base."""

    pattern: str
    target: str
    source: str
    wildcard: bool


def ordered(rules: list[Alias]) -> list[Alias]:
    """Longer patterns first, then the later source name; equal ones in the order given."""
    return sorted(rules, key=lambda r: (len(r.pattern), r.source), reverse=True)


def occurrences(sources: DataFrame) -> DataFrame:
    """(path, pos, raw_import, statement, import_nature) of every import in the text, repeats included."""
    return sources.select("path", F.posexplode(code.imports("content")).alias("pos", "i")).select("path", "pos", "i.raw_import", "i.statement", "i.import_nature")


def alias_bases(raw: Column, rules: list[Alias]) -> Column:
    """The paths that aliases make of an import, in the order of the rules. Rules are a few lines of configuration."""
    if not rules:
        return F.array().cast("array<string>")
    made = []
    for r in ordered(rules):
        if r.wildcard:
            rest = F.substr(raw, F.lit(len(r.pattern) + 1))
            # an absolute rest stands for itself
            joined = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit(r.target.rstrip("/") + "/" if r.target else ""), rest))
            made.append(F.when(F.startswith(raw, F.lit(r.pattern)), paths.normalized(joined)))
        else:
            made.append(F.when(raw == r.pattern, F.lit(r.target)))
    return F.array_distinct(F.filter(F.array(*made), lambda m: m.isNotNull()))


def targets(files: DataFrame) -> DataFrame:
    """(base, choice, candidate): for every path that an import may name, the file it means, and the place of that in ``paths.candidates``.

    A file answers to its own path, to its path without the extension and, if it is an
    index, to its folder, so that an import is joined once and not once a candidate.
    """
    path = F.col("path")
    named = [F.struct(path.alias("base"), F.lit(0).alias("choice"))]
    for n, ending in enumerate([*paths.EXTENSIONS, *(f"/index{e}" for e in paths.EXTENSIONS)], 1):
        base = F.substr(path, F.lit(1), F.length(path) - len(ending))
        # a base with an extension stands for itself alone
        named.append(F.when(F.endswith(path, F.lit(ending)) & (base != "") & ~paths.has_extension(base), F.struct(base.alias("base"), F.lit(n).alias("choice"))))
    known = files.where("path != ''").select("path", F.explode(F.filter(F.array(*named), lambda n: n.isNotNull())).alias("n"))
    return known.groupBy("n.base").agg(F.min(F.struct("n.choice", F.col("path").alias("candidate"))).alias("hit")).select("base", "hit.choice", "hit.candidate")


def classified(found: DataFrame, files: DataFrame, rules: list[Alias] | None = None) -> DataFrame:
    """occurrences with kind (resolved, unresolved, external), target, method, attempted and reason.

    files: path. The first candidate that is a file counts, in the order of aliases
    and then of completions.
    """
    raw = F.col("raw_import")
    relative = F.startswith(raw, F.lit("."))
    bases = F.when(relative, F.array(paths.normalized(paths.resolved("path", raw)))).otherwise(alias_bases(raw, rules or []))
    tried = found.withColumn("relative", relative).withColumn("bases", bases)
    known = targets(files)
    if rules:  # several bases for one import: the first with a file counts
        keys = ["path", "pos"]
        each = tried.select(*keys, F.posexplode("bases").alias("turn", "base")).join(known, "base")
        first = each.groupBy(*keys).agg(F.min(F.struct("turn", "choice", "candidate")).alias("hit")).select(*keys, "hit.choice", "hit.candidate")
        hits = tried.join(first, keys, "left")
    else:
        hits = tried.withColumn("base", F.get("bases", F.lit(0))).join(known, "base", "left")
    hit, has_alias = F.col("candidate").isNotNull(), F.size("bases") > 0
    kind = F.when(hit, "resolved").when(F.col("relative") | has_alias, "unresolved").otherwise("external")
    return hits.select(
        "path", "pos", "raw_import", "statement", "import_nature", kind.alias("kind"), F.col("candidate").alias("target"),
        F.when(F.col("choice") > 0, "extension_match").when(hit, "exact_match").alias("method"),
        F.array_distinct(F.flatten(F.transform("bases", lambda b: paths.candidates(b)))).alias("attempted"),
        F.when((kind == "unresolved") & ~F.col("relative"), ALIAS_MISSED).alias("reason"),
    )


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (source, target, import_nature): runtime if any of its imports is."""
    hits = resolved.where("kind = 'resolved'")
    return hits.groupBy(F.col("path").alias("source"), "target").agg(F.when(F.bool_or(F.col("import_nature") == "runtime"), "runtime").otherwise("type_only").alias("import_nature"))


def import_lists(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(path, targets): for every file its targets in source order, repeats kept, maybe none."""
    lists = resolved.where("kind = 'resolved'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("t"))
    return files.select("path").join(lists, "path", "left").select("path", F.coalesce(F.col("t.target"), F.array().cast("array<string>")).alias("targets"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'unresolved'").select(F.col("path").alias("importer"), "raw_import", "attempted", "reason")


def external(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'external'").select(F.col("path").alias("importer"), "raw_import")


def edge_resolution(resolved: DataFrame, sure: float = 0.95) -> DataFrame:
    """(source, target, raw_import, status, method, confidence) of each resolved import."""
    done = resolved.where("kind = 'resolved'")
    assumed = F.col("method") == "extension_match"
    return done.select(F.col("path").alias("source"), "target", "raw_import", F.when(assumed, "resolved_with_assumption").otherwise("resolved").alias("status"), "method", F.when(assumed, sure).otherwise(1.0).alias("confidence"))


def usages(resolved: DataFrame, sources: DataFrame, kinds=code.usage) -> DataFrame:
    """(source, target, symbol, usage): how importers use what they import. A file's text travels once, with all its symbols."""
    symbol = F.explode(code.imported_symbols("statement")).alias("symbol")
    named = resolved.where("kind = 'resolved'").select(F.col("path").alias("source"), "target", symbol)
    listed = named.groupBy("source").agg(F.collect_set(F.struct("target", "symbol")).alias("symbols"))
    joined = listed.join(sources.select(F.col("path").alias("source"), "content"), "source")
    used = joined.select("source", F.explode(F.transform("symbols", lambda s: F.struct(s.target.alias("target"), s.symbol.alias("symbol"), kinds(s.symbol, F.col("content")).alias("usage")))).alias("u"))
    return used.select("source", "u.target", "u.symbol", "u.usage").where("usage is not null")


def usage_lines(used: DataFrame) -> DataFrame:
    """(target, line): who uses what of a file, as ``importer -> usage(symbol)``."""
    return used.select("target", F.concat_ws(" -> ", "source", "usage").alias("line")).distinct()
