"""Operators on the dependency graph. Vertices: path. Edges: source, target.

Upstream is what a file imports, downstream what imports it, both transitively.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..session import stored

#: Rounds after which an iteration raises instead of returning a part.
MOST_ROUNDS = 200
#: Hops of an iteration between two writes.
STEPS = 4
#: Edges of a group that one task may hold at once, and edges times seeds that it may walk; larger groups are worked on by all machines.
WHOLE, WALKS = 200_000, 20_000_000
#: Seeds up to which a closure goes on from them hop by hop, without looking at files they do not reach.
FEW = 100


def fans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices with fan_in and fan_out over distinct edges, 0 where there are none."""
    pairs = edges.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    both = vertices.join(counts, "path", "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("fan_in", "fan_out")})


def neighbours(edges: DataFrame, path: str) -> DataFrame:
    """(direction, path): what a file imports, and what imports it."""
    out = edges.where(F.col("source") == path).select(F.lit("imports").alias("direction"), F.col("target").alias("path"))
    return out.union(edges.where(F.col("target") == path).select(F.lit("imported_by"), "source")).distinct()


def groups(pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, group): the hash of each file that has an edge to another, and a hash that all files share which edges join in whatever direction.

    Large stars and small stars take turns: a file's neighbours are tied to the least of
    them, till all of a group are tied to one; the rounds grow with the logarithm of a
    group's size. Files with equal hashes count as one here, so a group may be two at worst.
    """
    a, b = F.xxhash64("source"), F.xxhash64("target")
    stars = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    seen = None
    for _ in range(most_rounds):
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        stars = stored(small.where("u != v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("group")).union(stars.select("v", "v").distinct())
        seen = now
    raise RuntimeError(f"groups were not found in {most_rounds} rounds")


def in_groups(rows: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """rows with the group of a path; a path without edges to others is a group of its own."""
    return rows.withColumn("node", F.xxhash64(path)).join(found, "node", "left").withColumn("group", F.coalesce("group", "node")).drop("node")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by group: no more at once than a batch and a group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        if kept and kept[-1].column("group")[0].as_py() != group[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        cut = int(group.searchsorted(group[-1]))
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def by_group(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, path, depth) breadth first; rows without ``to`` are seeds."""
    seeds, reached, depths = [], [], []

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(seeds, pa.string()), pa.array(reached, pa.string()), pa.array(depths, pa.int32())], ["seed", "path", "depth"])
        for c in (seeds, reached, depths):
            c.clear()
        return batch

    for table in whole_groups(batches):
        step: dict[str, list[str]] = {}
        asked = []
        for path, to in zip(table.column("path").to_pylist(), table.column("to").to_pylist(), strict=True):
            if to is None:
                asked.append(path)
            else:
                step.setdefault(path, []).append(to)
        for seed in asked:
            found: dict[str, int] = {}
            frontier, depth = [seed], 0
            while frontier:
                depth += 1
                new = []
                for path in frontier:
                    for to in step.get(path, ()):
                        if to not in found:
                            found[to] = depth
                            new.append(to)
                frontier = new
            seeds += [seed] * len(found)
            reached += found
            depths += found.values()
            if len(seeds) > 50_000:
                yield made()
    if seeds:
        yield made()


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False, most_rounds: int = MOST_ROUNDS, steps: int = STEPS, few: int = FEW, most_walks: int = WALKS) -> DataFrame:
    """(seed, path, depth): all that is reachable over one or more edges, a seed itself only over a cycle; depth is the fewest edges.

    From more than ``few`` seeds files are grouped first, and each group is walked by the
    task that holds it; groups with more edges than ``WHOLE``, or with more than
    ``most_walks`` edges times seeds, go hop by hop.
    """
    pairs = stored(edges.select("source", "target").distinct())
    step = pairs.select(F.col("target").alias("path"), F.col("source").alias("to")) if reverse else pairs.toDF("path", "to")
    asked = stored(seeds.select("path").distinct())
    if asked.count() <= few:
        return hop_by_hop(step, asked, most_rounds, steps)
    found = groups(pairs)
    rows = stored(in_groups(step.union(asked.select("path", F.lit(None).cast("string"))), found, "path"))
    sizes = rows.groupBy("group").agg(F.count("to").alias("edges"), F.count_if(F.col("to").isNull()).alias("seeds"))
    large = stored(sizes.where((F.col("seeds") > 0) & ((F.col("edges") > WHOLE) | (F.col("edges") * F.col("seeds") > most_walks))).select("group"))
    shape = "seed string, path string, depth int"
    if large.isEmpty():
        return by_group(rows, walked, shape)
    apart = rows.join(large, "group", "left_semi")
    hops = hop_by_hop(apart.where(F.col("to").isNotNull()).select("path", "to"), apart.where(F.col("to").isNull()).select("path"), most_rounds, steps)
    return by_group(rows.join(large, "group", "left_anti"), walked, shape).union(hops)


def hop_by_hop(step: DataFrame, seeds: DataFrame, most_rounds: int, steps: int) -> DataFrame:
    """The closure of (path, to), where all machines work on each hop.

    ``steps`` hops run between two writes, each from what the one before found; what is
    known is dropped once for all of them. What is written lies in reliable storage, so
    plans stay short and a lost executor costs no more than that.
    """
    frontier, found, depth = seeds.select(F.col("path").alias("seed"), "path"), None, 0
    while depth <= most_rounds:
        hops, hop, n = None, frontier, min(steps, most_rounds + 1 - depth)
        for k in range(1, n + 1):
            hop = hop.join(step, "path").select("seed", F.col("to").alias("path")).distinct()
            reached = hop.withColumn("depth", F.lit(depth + k))
            hops = reached if hops is None else hops.union(reached)
        new = hops.groupBy("seed", "path").agg(F.min("depth").alias("depth"))
        new = stored(new if found is None else new.join(found, ["seed", "path"], "left_anti"))
        found = new if found is None else found.union(new)
        depth += n
        # what was found before the last hop has been followed already
        frontier = new.where(F.col("depth") == depth).select("seed", "path")
        if frontier.isEmpty():
            return found
        if depth % (8 * steps) == 0:
            found = stored(found)
    raise RuntimeError(f"the closure is deeper than {most_rounds} rounds")


def impact_sets(edges: DataFrame, target: str) -> DataFrame:
    """(relation, path): upstream, downstream and the direct ones of a target, which itself is left out."""
    edges = stored(edges.select("source", "target").distinct())
    seed = edges.sparkSession.createDataFrame([(target,)], "path string")
    parts = [closure(edges, seed, back).where(F.col("path") != target).select(F.lit(name).alias("relation"), "path") for name, back in (("upstream", False), ("downstream", True))]
    direct = neighbours(edges, target).select(F.when(F.col("direction") == "imports", "direct_upstream").otherwise("direct_downstream").alias("relation"), "path")
    return parts[0].union(parts[1]).union(direct.where(F.col("path") != target))


def on_cycles(edges: DataFrame, most_rounds: int = MOST_ROUNDS, steps: int = STEPS, whole: int = WHOLE) -> DataFrame:
    """(path, component): files that reach themselves, a file that imports itself among them, by strongly connected component.

    A component lies within a group of files that edges join in whatever direction. A
    group of at most ``whole`` edges is searched by the task that holds it; larger ones
    by labels.
    """
    pairs = stored(edges.select("source", "target").distinct())
    rows = stored(in_groups(pairs, groups(pairs), "source"))
    large = stored(rows.groupBy("group").count().where(F.col("count") > whole).select("group"))
    shape = "path string, component string"
    if large.isEmpty():
        return by_group(rows, searched, shape)
    return by_group(rows.join(large, "group", "left_anti"), searched, shape).union(by_labels(rows.join(large, "group", "left_semi"), most_rounds, steps))


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, component) of whole groups, depth first (Tarjan); the greatest file names a component."""
    for table in whole_groups(batches):
        after: dict[str, list[str]] = {}
        loops = set()
        for source, target in zip(table.column("source").to_pylist(), table.column("target").to_pylist(), strict=True):
            after.setdefault(source, []).append(target)
            if source == target:
                loops.add(source)
        place: dict[str, int] = {}
        low: dict[str, int] = {}
        left: set[str] = set()  # files whose component is known
        open_, paths_, names = [], [], []
        for first in after:
            if first in place:
                continue
            place[first] = low[first] = len(place)
            open_.append(first)
            calls = [(first, iter(after[first]))]
            while calls:
                file, todo = calls[-1]
                for to in todo:
                    if to not in place:
                        place[to] = low[to] = len(place)
                        open_.append(to)
                        calls.append((to, iter(after.get(to, ()))))
                        break
                    if to not in left:
                        low[file] = min(low[file], place[to])
                else:
                    calls.pop()
                    if calls:
                        low[calls[-1][0]] = min(low[calls[-1][0]], low[file])
                    if low[file] == place[file]:
                        members = []
                        while not members or members[-1] != file:
                            members.append(open_.pop())
                        left.update(members)
                        if len(members) > 1 or file in loops:
                            paths_ += members
                            names += [max(members)] * len(members)
        if paths_:
            yield pa.RecordBatch.from_arrays([pa.array(paths_, pa.string()), pa.array(names, pa.string())], ["path", "component"])


def by_labels(edges: DataFrame, most_rounds: int = MOST_ROUNDS, steps: int = STEPS) -> DataFrame:
    """The same of groups of any size, where all machines work on each hop.

    A file holds two labels: the greatest file that reaches it, and the greatest that it
    reaches. Where they are equal, it is in that file's component; such files leave, and
    the rest goes on among edges whose ends agree in both labels, since a component never
    lies across others. So a file costs two labels a round, not all that it reaches.
    ``steps`` hops run between two writes. Running out of rounds raises.
    """
    pairs = stored(edges.select("source", "target").distinct())
    loops = pairs.where("source = target").select(F.col("source").alias("path"), F.col("source").alias("component"))
    rest, found = trimmed_to_cycles(pairs.where("source != target")), None
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        ends = rest.select(F.explode(F.array("source", "target")).alias("path")).distinct()
        state = stored(ends.select("path", F.col("path").alias("from"), F.col("path").alias("to")))
        for _ in range(most_rounds):
            grown = state.withColumn("moved", F.lit(False))
            for _ in range(steps):
                forth = rest.join(grown.select(F.col("path").alias("source"), "from"), "source").select(F.col("target").alias("path"), "from", F.lit("").alias("to"))
                back = rest.join(grown.select(F.col("path").alias("target"), "to"), "target").select(F.col("source").alias("path"), F.lit("").alias("from"), "to")
                sent = forth.union(back).groupBy("path").agg(F.max("from").alias("f"), F.max("to").alias("t"))
                joined = grown.join(sent, "path")  # every file here has both kinds of edges
                grown = joined.select("path", F.greatest("from", "f").alias("from"), F.greatest("to", "t").alias("to"), ((F.col("f") > F.col("from")) | (F.col("t") > F.col("to"))).alias("moved"))
            grown = stored(grown)
            state = grown.drop("moved")
            if grown.where("moved").isEmpty():  # the last hop changed nothing
                break
        else:
            raise RuntimeError(f"labels did not settle in {most_rounds} rounds")
        whole = state.where(F.col("from") == F.col("to")).select("path", F.col("from").alias("component"))
        found = whole if found is None else found.union(whole)
        left = state.where(F.col("from") != F.col("to"))
        of = lambda end: left.select(F.col("path").alias(end), F.struct("from", "to").alias(f"{end}_labels"))
        rest = trimmed_to_cycles(rest.join(of("source"), "source").join(of("target"), "target").where("source_labels = target_labels").select("source", "target"))
    else:
        raise RuntimeError(f"components were not found in {most_rounds} rounds")
    if found is None:
        return loops
    return loops.join(found, "path", "left_anti").union(found)


def trimmed_to_cycles(edges: DataFrame, most_rounds: int = MOST_ROUNDS, steps: int = 2) -> DataFrame:
    """Edges left after repeatedly dropping those whose source nothing imports or whose target imports nothing."""
    rest = stored(edges.select("source", "target").distinct())
    size = rest.count()
    for _ in range(most_rounds):
        kept = rest
        for _ in range(steps):
            kept = kept.join(kept.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = stored(kept.select("source", "target"))
        if (now := kept.count()) == size:
            return kept
        rest, size = kept, now
    return rest  # a superset is enough for what follows


def simple_cycles(edges: DataFrame, longest: int = 12) -> tuple[DataFrame, bool]:
    """(cycle: array of paths from its least one on), and whether paths longer than ``longest`` were left.

    Self-imports are not counted. Paths only grow over files greater than their
    first, so a cycle is found once.
    """
    step = stored(trimmed_to_cycles(edges.where("source != target")).toDF("from", "to"))
    walks = stored(step.where(F.col("from") < F.col("to")).select(F.array("from", "to").alias("walk")))
    done = None
    for _ in range(longest - 1):
        ended = walks.withColumn("from", F.element_at("walk", -1)).join(step, "from").where(F.col("to") == F.col("walk")[0]).select(F.col("walk").alias("cycle"))
        done = ended if done is None else done.union(ended)
        grown = walks.withColumn("from", F.element_at("walk", -1)).join(step, "from").where((F.col("to") > F.col("walk")[0]) & ~F.array_contains("walk", F.col("to")))
        walks = stored(grown.select(F.concat("walk", F.array("to")).alias("walk")))
        if walks.isEmpty():
            return done, False
    return done, True


def boundaries(files: DataFrame, root: str = ".") -> DataFrame:
    """(path, boundary, barrel): a file's deepest folder with a barrel, from root down, else its top folder, else root.

    With root ``.`` no folder counts as below it, so top folders it is: files named
    from ``.`` do not begin with it.
    """
    root = root.rstrip("/") or "."
    own = files.select("path", paths.dirname("path").alias("dir"))
    barrels = own.where(paths.basename("path").isin(*paths.BARRELS)).groupBy(F.col("dir").alias("folder")).agg(F.max("path").alias("barrel"))
    above = own.select("path", F.posexplode_outer(F.filter(paths.ancestors("path"), lambda a: F.startswith(a, F.lit(root)))).alias("up", "folder"))
    nearest = above.join(barrels, "folder", "left").groupBy("path").agg(F.min(F.when(F.col("barrel").isNotNull(), F.struct("up", "folder"))).alias("hit"))
    prefix = "" if root == "." else root + "/"
    below = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    top = F.when(F.contains(below, F.lit("/")), F.concat(F.lit(prefix), F.substring_index(below, "/", 1))).otherwise(root)
    named = nearest.select("path", F.coalesce(F.col("hit.folder"), top).alias("boundary"))
    return named.join(barrels.withColumnRenamed("folder", "boundary"), "boundary", "left").select("path", "boundary", "barrel")


def boundary_lists(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("boundary").agg(F.first("barrel").alias("barrel"), F.sort_array(F.collect_list("path")).alias("files"))


def guarded_links(spark: SparkSession, proposals: DataFrame, edges: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(op_seq, source, target, kind, accepted): proposals in order; an inferential one that closes a cycle, with edges (source, target) that are there or were accepted, is refused.

    Each decision depends on those before it, so they are made on the driver, over at
    most ``most`` proposals; more raise. Of the edges only which ends of proposals reach
    which comes there, at most the square of that.
    """
    rows = proposals.select("op_seq", "source", "target", "kind").orderBy("op_seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} proposals")
    after: dict[str, set[str]] = {}
    if edges is not None:
        ends = stored(proposals.select(F.explode(F.array("source", "target")).alias("path")).distinct())
        for r in closure(edges, ends).join(F.broadcast(ends), "path", "left_semi").collect():  # 2 * most ends
            after.setdefault(r.seed, set()).add(r.path)

    def reaches(a: str, b: str) -> bool:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            new = after.get(x, set()) - seen
            seen |= new
            todo += new
        return False

    out = []
    for r in rows:
        fine = r.kind != "inferential" or not reaches(r.target, r.source)
        if fine:
            after.setdefault(r.source, set()).add(r.target)
        out.append((r.op_seq, r.source, r.target, r.kind, fine))
    return spark.createDataFrame(out, "op_seq int, source string, target string, kind string, accepted boolean")


def risk(fan_in: Column, high: int = 3) -> Column:
    """struct(level, reasons). Only a fan-in of 3 as medium is known behaviour; the scale is a parameter of ours."""
    many = fan_in >= high
    return F.struct(F.when(fan_in >= 4 * high, "high").when(many, "medium").otherwise("low").alias("level"), F.when(many, F.array(F.lit("high_fan_in"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
