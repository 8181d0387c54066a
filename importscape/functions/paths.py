"""Functions of paths, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions in the order in which an import is completed, names of
# barrel files, directories that are never scanned.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
BARRELS = ("index.ts", "index.tsx", "index.js", "index.jsx", "public-api.ts")
IGNORED = ("node_modules", ".git", "dist", ".angular", ".Jules", "coverage", ".next", "out", "fixtures_min")

# Base name pattern, kind and confidence of entry points; the first that fits counts.
ENTRYPOINTS = (
    (r"^main\.server\.(ts|js)$", "ssr_bootstrap", 0.95),
    (r"^main\.(ts|js)$", "browser_bootstrap", 0.95),
    (r"^server\.(ts|js)$", "server_http", 0.90),
    (r"^entry\.server\.(ts|js)$", "ssr_bootstrap", 0.90),
    (r"^entry\.client\.(ts|js)$", "browser_bootstrap", 0.90),
    (r"^bootstrap\.(ts|js)$", "app_bootstrap", 0.80),
)

# What the topology view takes a path for, whatever its case; the first that fits counts.
SHOWN_TYPES = (
    (r"service\.ts\z", "Service"),
    (r"(component\.ts|(\A|/)app\.ts)\z", "Component"),
    (r"(module|routes?|config)(\.|/)", "Module"),
    (r"(\A|/)(utils?|helpers?)(/|\z)", "Helper"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of(pairs, default: Column) -> Column:
    """CASE over (condition, value) pairs, the first true one counts."""
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(list(pairs)), default)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """The path without its last segment; empty for a bare name."""
    return F.regexp_replace(_col(path), r"/?[^/]*\z", "")


def normalized(path: Column | str) -> Column:
    """Without ``.``, doubled slashes and resolvable ``..``; backslashes become slashes; empty becomes ``.``."""
    path = _col(path)
    absolute = F.startswith(path, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("..")), kept), -1)  # ".." if there is nothing to leave
        up = F.when(last != "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.when(absolute, kept).otherwise(F.concat(kept, F.array(part))))
        return F.when((part == "") | (part == "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    folded = F.concat_ws("/", F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step))
    whole = F.when(absolute, F.concat(F.lit("/"), folded)).when(folded == "", ".").otherwise(folded)
    return F.regexp_replace(F.replace(whole, F.lit("\\"), F.lit("/")), r"\A\./", "")


def resolved(importer: Column | str, imported: Column | str) -> Column:
    """A relative import against its importer's directory; ``..`` above the root is dropped; other imports stay."""
    imported, base = _col(imported), dirname(importer)

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when((part == "") | (part == "."), kept).otherwise(F.concat(kept, F.array(part)))

    start = F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, "/"))
    folded = F.concat_ws("/", F.aggregate(F.split(imported, "/"), start, step))
    return F.when(F.startswith(imported, F.lit(".")), folded).otherwise(imported)


def has_extension(path: Column | str) -> Column:
    return _col(path).rlike(r"\.(ts|tsx|js|jsx)\z")


def is_source(path: Column | str) -> Column:
    return has_extension(path) & ~F.endswith(_col(path), F.lit(".d.ts"))


def is_test(path: Column | str) -> Column:
    return basename(path).rlike(r"\.(spec|test)\.(ts|tsx|js|jsx)\z")


def is_ignored(path: Column | str, ignored=IGNORED) -> Column:
    """Whether a directory of the path is one that is never scanned, or starts with a dot."""
    parts = F.filter(F.split(dirname(path), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*ignored))


def entrypoint(path: Column | str) -> Column:
    """struct(is_entrypoint, kind, confidence)."""
    made = lambda yes, kind, sure: F.struct(F.lit(yes).alias("is_entrypoint"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    return first_of([(basename(path).rlike(p), made(True, kind, sure)) for p, kind, sure in ENTRYPOINTS], made(False, "none", 0.0))


def node_type(path: Column | str, content: Column | str) -> Column:
    """The role of a file in the built graph, by its path and its decorators."""
    low, text = F.lower(_col(path)), _col(content)
    return first_of(
        [
            (F.contains(low, F.lit(".service.")) | F.contains(text, F.lit("@Injectable")), F.lit("Service")),
            (F.contains(low, F.lit(".component.")) | F.contains(text, F.lit("@Component")), F.lit("Component")),
            (F.contains(low, F.lit(".module.")) | F.contains(low, F.lit(".routes.")), F.lit("Module")),
            (F.contains(low, F.lit("util")) | F.contains(low, F.lit("helper")), F.lit("Helper")),
        ],
        F.lit("Other"),
    )


def topology_type(path: Column | str) -> Column:
    """The role that the topology view shows, by the path alone; it differs from ``node_type`` on purpose."""
    return first_of([(_col(path).rlike(f"(?i){p}"), F.lit(kind)) for p, kind in SHOWN_TYPES], F.lit("Other"))


def relative_to(root: str, path: Column | str) -> Column:
    """A path below root, from root; root itself is ``.``."""
    prefix = root.rstrip("/") + "/"
    path = normalized(path)
    return F.when(path == root.rstrip("/"), ".").when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def inside(root: str, target: Column | str) -> Column:
    """target resolved against root; raises where it leads out of root."""
    target = _col(target)
    whole = normalized(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), target)))
    fits = (whole == root.rstrip("/")) | F.startswith(whole, F.lit(root.rstrip("/") + "/"))
    return F.when(fits, whole).otherwise(F.raise_error(F.concat(F.lit("Target must stay inside the root: "), target)))


def ancestors(path: Column | str) -> Column:
    """The directories above a path, the deepest first."""
    parts = F.split(dirname(path), "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(dirname(path) == "", F.array().cast("array<string>")).otherwise(every)


def candidates(base: Column | str) -> Column:
    """The files an import may mean, in order: as written; without a known extension also with each, and as a folder's index."""
    base = _col(base)
    more = [F.concat(base, F.lit(e)) for e in EXTENSIONS] + [F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS]
    return F.filter(F.array_distinct(F.when(has_extension(base), F.array(base)).otherwise(F.array(base, *more))), lambda c: c != "")
