"""Reading source trees and configuration, and writing graphs."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, paths
from ..operators.imports import Alias

MANIFEST = "path string, size long, mtime_ns long, ctime_ns long"
# Names of configuration files that may hold aliases, in the order in which they are read.
CONFIGS = ("tsconfig.json", "jsconfig.json", "tsconfig.base.json", "tsconfig.app.json")


def discover(spark: SparkSession, root: str = ".", ignored=paths.IGNORED) -> DataFrame:
    """The manifest (path, size, mtime_ns, ctime_ns) of a local tree, by path; unreadable entries are skipped.

    Listed on the driver, because only there are all three stamps exact; for trees in
    a store that only Spark reads, ``read_tree`` lists in Spark.
    """
    rows = []
    for top, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in ignored and not f.startswith("."))
        for name in names:
            if name.endswith(paths.EXTENSIONS) and not name.endswith(".d.ts"):
                path = os.path.join(top, name)
                try:
                    s = os.stat(path)
                except OSError:
                    continue
                rows.append((os.path.normpath(path), s.st_size, s.st_mtime_ns, s.st_ctime_ns))
    return spark.createDataFrame(sorted(rows), MANIFEST)


def read_tree(spark: SparkSession, root: str, ignored=paths.IGNORED, keep_root: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """(path, content) of a tree, listed and read by Spark; bytes that are no UTF-8 are dropped.

    Spark's listing skips names that begin with ``_`` or ``.``, and empty files; files
    of a manifest that are missing so are added with empty content. Dropping bad
    bytes also drops a genuine U+FFFD.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    base = os.path.abspath(root).rstrip("/") if "://" not in root else re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    below = F.substr(full, F.lit(len(base) + 2))
    path = paths.normalized(F.concat(F.lit(root.rstrip("/") + "/"), below)) if keep_root else below
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    read = raw.select(path.alias("path"), below.alias("below"), text.alias("content")).where(paths.is_source("below") & ~paths.is_ignored("below", ignored)).drop("below")
    if manifest is None:
        return read
    return read.join(manifest.select("path").distinct(), "path", "full").select("path", F.coalesce("content", F.lit("")).alias("content"))


def from_snapshot(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, stored imports) of a snapshot (path, content, imports array<string>).

    Rows without a path or without content and imports are dropped. Stored imports
    stand in, as runtime, for files whose content is empty.
    """
    fine = snapshot.where(F.col("path").isNotNull() & (F.col("content").isNotNull() | F.col("imports").isNotNull()))
    sources = fine.select("path", F.coalesce("content", F.lit("")).alias("content"))
    kept = fine.where(F.coalesce("content", F.lit("")) == "").select("path", F.posexplode("imports").alias("pos", "raw_import"))
    return sources, kept.select("path", "pos", "raw_import", F.lit("").alias("statement"), F.lit("runtime").alias("import_nature"))


def alias_rules(configs: dict[str, str]) -> list[Alias]:
    """The aliases of configurations (path -> text), in the order given; what is no JSON is skipped."""
    rules: list[Alias] = []
    for path, text in configs.items():
        try:
            options = json.loads(code.plain_json(text)).get("compilerOptions") or {}
        except (ValueError, AttributeError):
            continue
        base = os.path.normpath(os.path.join(os.path.dirname(path) or ".", options.get("baseUrl") or "."))
        for pattern, targets in (options.get("paths") or {}).items():
            for target in targets if isinstance(targets, list) else []:
                if isinstance(target, str):
                    wild = pattern.endswith("/*")
                    end = target[:-1] if wild and target.endswith("/*") else target
                    rules.append(Alias(pattern[:-1] if wild else pattern, os.path.normpath(os.path.join(base, end)), path, wild))
    return rules


def config_folders(root: str) -> list[str]:
    """Where aliases of a tree may be configured: its root, the folders above it, up to the working folder for a relative root, and that folder."""
    folder = os.path.normpath(root or ".")
    found = [folder]
    while folder not in (".", os.path.dirname(folder)):
        folder = os.path.dirname(folder) or "."
        found.append(folder)
    return list(dict.fromkeys([*found, "."]))


def find_aliases(root: str = ".") -> list[Alias]:
    """The aliases of a local tree; a few files on the driver."""
    configs: dict[str, str] = {}
    for folder in config_folders(root):
        for name in CONFIGS:
            path = os.path.normpath(os.path.join(folder, name))
            if path not in configs and os.path.isfile(path):
                with open(path, encoding="utf-8", errors="ignore") as f:
                    configs[path] = f.read()
    return alias_rules(configs)


def write_graph(frames: dict[str, DataFrame], out: str) -> None:
    """Each frame as JSON lines in a folder of its name, without contents of files."""
    for name, frame in frames.items():
        frame.drop("content").write.mode("overwrite").json(f"{out}/{name}")


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a topology document."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def write_document(spark: SparkSession, document: dict[str, DataFrame], facts: dict, out: str, most_rows: int = 200_000) -> None:
    """One JSON document of a graph that is small enough for the driver: facts, then each frame as a list; more rows raise.

    Frames of larger graphs go to ``write_graph``.
    """
    whole = dict(facts)
    for name, frame in document.items():
        rows = frame.drop("content").limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        whole[name] = [r.asDict(recursive=True) for r in rows]
    with open(out, "w", encoding="utf-8") as f:
        json.dump(whole, f, indent=2, ensure_ascii=False)
