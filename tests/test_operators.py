import json

import pytest

from importscape.operators import analyzers, graph, imports, shapes
from importscape.plans import graph as plans
from importscape.sources import files
from importscape.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_imports_in_order_with_repeats(spark):
    text = "// import 'no'\nimport x from './a';\nimport './b'; export * from './a';\nconst l = import('./c');\nconst r = require('./d');"
    found = imports.occurrences(spark.createDataFrame([("p.ts", text), ("q.ts", ""), ("r.ts", None)], "path string, content string"))
    assert rows(found.select("path", "pos", "raw_import")) == [("p.ts", 0, "./a"), ("p.ts", 1, "./b"), ("p.ts", 2, "./a"), ("p.ts", 3, "./c")]


def test_no_files(spark):
    g = plans.build(spark.createDataFrame([], "path string, content string"))
    assert g.edges.count() == 0 and g.nodes.count() == 0
    assert plans.summary(g).first().files == 0
    assert plans.impact(g, "x").first().exists is False


def test_a_file_may_import_itself(spark):
    g = plans.build(spark.createDataFrame([("a.ts", "import './a'")], "path string, content string"))
    assert rows(g.nodes.select("fan_in", "fan_out")) == [(1, 1)]


def test_runtime_wins_over_types(spark):
    g = plans.build(spark.createDataFrame([("a.ts", "import type { X } from './b'; import { X } from './b'"), ("b.ts", "")], "path string, content string"))
    assert rows(g.edges) == [("a.ts", "b.ts", "runtime")]


def test_closure_raises_rather_than_cuts(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "source string, target string")
    with pytest.raises(RuntimeError):
        graph.closure(edges, spark.createDataFrame([("0",)], "path string"), most_rounds=3)


def test_bodies(spark):
    assert shapes.body_properties(" a: { b: string; c?: number }; readonly d: Map<x, y>; [k: string]: z; get: 1; f(x: number, y: string): void ") == {"a", "a.b", "a.c", "d", "f"}
    assert shapes.body_properties("'q': 1, r: '}', s: `{` ") == {"r", "s"}
    assert shapes.closing_brace("{ '}' { } }", 0) == 10 and shapes.closing_brace("{ {", 0) == -1


SHAPED = [
    ("s.ts", "export interface Crate { id: number; owner: { name: string; tags: string[] } }\nexport class Shop {}\n"),
    ("p.ts", "import type { Crate } from './s';\nexport type Marked = Crate & { note?: string };\nexport type Loose = Partial<Marked>;\n"),
    ("t.ts", "export interface Wide extends Marked, Crate {\n  [key: string]: unknown;\n  readonly size: number;\n  load(): Promise<void>;\n}\n"),
]


def test_shapes_inherit_across_files(spark):
    found = {n: ",".join(p) for _, n, p in rows(shapes.type_shapes(spark.createDataFrame(SHAPED, "path string, content string")))}
    assert found["Crate"] == "id,owner,owner.name,owner.tags"
    assert found["Marked"] == "id,note,owner,owner.name,owner.tags"
    assert found["Loose"] == found["Marked"]
    # what another file lends is what that file knows by itself: Marked as declared there
    assert found["Wide"] == "id,load,note,owner,owner.name,owner.tags,size"


def test_parents():
    told = {
        "type T = A & B & C": ["A", "C"], "type T = A | string | C": ["A", "C"], "type T = Omit<A, 'x'> & Pick<B, 'y'>": ["A", "B"], "type T<X> = { k: B | C | D }": ["C"],
        "interface T extends B<C>, D": ["BC", "D"], "interface T<X extends Y>": ["Y"], "type T = A;": ["A"], "type T = A = B": ["B"], "type T = () => A": [],
    }
    for text, wanted in told.items():
        assert shapes.declarations(text + (" {}" if text.startswith("interface") else ""))["T"][1] == wanted, text


def test_a_string_at_the_end_of_a_body_leaves_its_member_open():
    assert shapes.body_properties("a: 1; b: 'x'") == {"a"} and shapes.body_properties("a: 1; b: 'x' ") == {"a", "b"}


def test_guard_sees_edges_that_are_there(spark):
    asked = spark.createDataFrame([(1, "A", "B", "inferential"), (2, "B", "C", "inferential"), (3, "C", "A", "inferential"), (4, "C", "A", "related"), (5, "C", "D", "inferential"), (6, "D", "E", "inferential")], "op_seq int, source string, target string, kind string")
    accepted = lambda edges: {r.op_seq: r.accepted for r in graph.guarded_links(spark, asked, edges).collect()}
    assert accepted(None) == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    there = spark.createDataFrame([("E", "X"), ("X", "B")], "source string, target string")
    assert accepted(there) == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    with pytest.raises(ValueError):
        graph.guarded_links(spark, asked, None, most=3)


def test_components_against_force(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        edges = {(f"v{r.randrange(30)}", f"v{r.randrange(30)}") for _ in range(45)}
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)
        reach = {}
        for v in {x for e in edges for x in e}:
            seen, todo = set(), list(after.get(v, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            reach[v] = seen
        wanted = sorted((v, max(w for w in reach if w in reach[v] and v in reach[w])) for v in reach if v in reach[v])
        assert rows(graph.on_cycles(spark.createDataFrame(sorted(edges), "source string, target string")).select("path", "component")) == wanted
    assert rows(graph.on_cycles(spark.createDataFrame([("a", "b")], "source string, target string"))) == []


def test_walks_left_at_the_bound_are_reported(spark):
    ring = spark.createDataFrame([(f"v{i}", f"v{(i + 1) % 5}") for i in range(5)], "source string, target string")
    assert graph.simple_cycles(ring, 5)[0].count() == 1 and not graph.simple_cycles(ring, 5)[1]
    found, left = graph.simple_cycles(ring, 3)
    assert found.count() == 0 and left


def test_alias_targets_are_normalized_and_misses_have_a_reason(spark):
    files_ = spark.createDataFrame([("src/x.ts", ""), ("src/app/y/index.tsx", ""), ("m.ts", "import a from '@app/../x'; import b from '@app/y'; import c from '@app/no'; import d from './src/x'; import e from './src/nothing.js'; import f from 'kit'")], "path string, content string")
    g = plans.build(files_, [imports.Alias("@app/", "src/app", "t.json", True)])
    found = {r.raw_import: (r.kind, r.target, r.reason) for r in g.resolved.collect()}
    assert found == {
        "@app/../x": ("resolved", "src/x.ts", None), "@app/y": ("resolved", "src/app/y/index.tsx", None), "@app/no": ("unresolved", None, "alias_candidate_not_found"),
        "./src/x": ("resolved", "src/x.ts", None), "./src/nothing.js": ("unresolved", None, None), "kit": ("external", None, None),
    }


def test_the_first_candidate_counts(spark):
    names = ["a", "a.tsx", "a.ts", "a/index.ts", "b.js", "b.js.ts", "b.js/index.ts", "c/index.jsx", "c/index.js", "d.ts.ts"]
    sources = spark.createDataFrame([(n, "") for n in names] + [("m.ts", "import './a'; import './b.js'; import './c'; import './d.ts'; import './c/index'")], "path string, content string")
    assert [r.target for r in plans.build(sources).resolved.orderBy("pos").collect()] == ["a", "b.js", "c/index.js", None, "c/index.js"]


def test_folders_of_configurations():
    assert files.config_folders("a/b") == ["a/b", "a", "."] and files.config_folders(".") == ["."]
    assert files.config_folders("/x/y") == ["/x/y", "/x", "/", "."]


def test_where_shared_work_is_kept(spark, monkeypatch):
    from importscape import session

    class Elsewhere:
        master = "spark://h:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Elsewhere()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    assert session.shared_dir(spark)


def test_document(spark, tmp_path):
    g = plans.build(spark.createDataFrame([("a.ts", "import './b'; import 'kit'"), ("b.ts", "export interface B { x: number }"), ("c.ts", None)], "path string, content string"))
    frames, facts = plans.document(g)
    files.write_document(spark, frames, facts, str(tmp_path / "g.json"))
    whole = json.loads((tmp_path / "g.json").read_text())
    assert whole["schema_version"] == plans.SCHEMA_VERSION and [v["path"] for v in whole["vertices"]] == ["a.ts", "b.ts", "c.ts"]
    assert whole["edges"] == [{"source": "a.ts", "target": "b.ts", "import_nature": "runtime"}] and whole["type_shapes"][0]["props"] == ["x"]
    assert plans.diagnostics(g).first().skipped_files == 1 and plans.runtime(spark).first().version == spark.version
    with pytest.raises(ValueError):
        files.write_document(spark, frames, facts, str(tmp_path / "h.json"), most_rows=2)


def test_signature_ignores_order_and_sees_changes(spark):
    data = [("a.ts", "import './b'"), ("b.ts", ""), ("c.ts", "")]
    sign = lambda d: plans.signature(plans.build(spark.createDataFrame(d, "path string, content string"))).first().signature
    assert sign(data) == sign(data[::-1]) != sign(data[:2])


def test_tree_on_disk(spark, tmp_path):
    for name, text in {"src/a.ts": b"import './b'\xff", "src/b.tsx": b"", "src/c.d.ts": b"", "src/node_modules/x.ts": b"", "src/.h/x.ts": b"", "src/e.md": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    root = str(tmp_path / "src")
    assert [r.path for r in files.discover(spark, root).collect()] == [f"{root}/a.ts", f"{root}/b.tsx"]
    assert rows(files.read_tree(spark, root, keep_root=False)) == [("a.ts", "import './b'")]
    assert rows(files.read_tree(spark, root, manifest=files.discover(spark, root))) == [(f"{root}/a.ts", "import './b'"), (f"{root}/b.tsx", "")]
    out = str(tmp_path / "out")
    g = plans.build(files.read_tree(spark, root, manifest=files.discover(spark, root)))
    files.write_graph({"edges": g.edges, "nodes": g.nodes}, out)
    assert spark.read.json(f"{out}/edges").count() == 1


def test_alias_configuration():
    text = '{\n // c\n "compilerOptions": { "baseUrl": "src", "paths": { "@a/*": ["lib/*"], "@b": ["b.ts"], "@c": "bad" } }, }'
    rules = files.alias_rules({"w/tsconfig.json": text, "broken.json": "{"})
    assert [(r.pattern, r.target, r.wildcard) for r in rules] == [("@a/", "w/src/lib", True), ("@b", "w/src/b.ts", False)]


def test_snapshot(spark):
    snap = spark.createDataFrame([("a.ts", "", ["./b"]), ("b.ts", "x", None), (None, "y", []), ("c.ts", None, None)], "path string, content string, imports array<string>")
    sources, stored = files.from_snapshot(snap)
    g = plans.build(sources, stored_imports=stored)
    assert rows(g.edges) == [("a.ts", "b.ts", "runtime")]


def test_unchanged_means_all_three_stamps(spark):
    a = spark.createDataFrame([("x", 1, 2, 3), ("y", 1, 2, 3)], files.MANIFEST)
    b = spark.createDataFrame([("x", 1, 2, 4), ("y", 1, 2, 3), ("z", 1, 1, 1)], files.MANIFEST)
    assert rows(incremental.manifest_diff(a, b)) == [("x", "changed"), ("y", "reused"), ("z", "added")]
    assert incremental.cache_status(incremental.manifest_diff(a, b)).first().hit_ratio == pytest.approx(1 / 3)


def test_paths_of_a_record(spark):
    record = spark.createDataFrame([("/r/a.ts", ["/r/b/c.ts", None], 3)], "target string, upstream array<string>, n int")
    assert json.loads(plans.from_root(record, "/r").toJSON().first()) == {"target": "a.ts", "upstream": ["b/c.ts"], "n": 3}


def test_a_failing_analyzer_is_reported(spark, monkeypatch):
    monkeypatch.setitem(analyzers.ANALYZERS, "bad", lambda nodes, edges: 1 / 0)
    g = plans.build(spark.createDataFrame([("main.ts", "")], "path string, content string"))
    found, errors = analyzers.run(g.nodes, g.edges)
    assert found.count() == 1 and "ZeroDivisionError" in errors["bad"]
    whole = analyzers.envelope(g.nodes, g.edges).first()
    assert (whole.total_findings, whole.analyzers_run, whole.analyzers_failed) == (1, 2, 1) and whole.errors[0].startswith("bad: ZeroDivisionError")


def counted(spark, data):
    """Sources that count how often a text is asked for."""
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    made = spark.createDataFrame(data, "path string, content string")
    return made.mapInArrow(pass_on, "path string, content string").where(F.lit(True)), asked


def test_shapes_read_each_text_once(spark):
    sources, asked = counted(spark, SHAPED)
    assert len(rows(shapes.type_shapes(sources))) == 4 and asked.value == len(SHAPED)


def test_outline_reads_only_texts_that_may_lend(spark, monkeypatch):
    data = [*SHAPED, ("u.ts", "export type Plain = { a: 1; b: 2 };\n")]
    every = {(p, n): v for p, n, v in rows(shapes.type_shapes(spark.createDataFrame(data, "path string, content string")))}
    sources, asked = counted(spark, data)
    found = rows(shapes.type_shapes(sources, "t.ts"))
    assert found == [("t.ts", "Wide", every["t.ts", "Wide"])] and asked.value <= 2 * len(data)
    assert rows(shapes.type_shapes(sources, "u.ts")) == [("u.ts", "Plain", ["a", "b"])] and rows(shapes.type_shapes(sources, "none.ts")) == []


def test_types_without_properties_and_parents_from_many_files(spark):
    data = [("a.ts", "interface E {}\ninterface M extends E, N, Gone { x: 1; }"), ("b.ts", "interface N { y: 1; }"), ("c.ts", "type N = { z: number; }"), ("d.ts", None), ("e.ts", "interface E extends M { w: 1; }")]
    found = {(p, n): v for p, n, v in rows(shapes.type_shapes(spark.createDataFrame(data, "path string, content string")))}
    # what e.ts lends from M is M as a.ts knows it, and a.ts has an E of its own
    assert found == {("a.ts", "E"): [], ("a.ts", "M"): ["x", "y", "z"], ("b.ts", "N"): ["y"], ("c.ts", "N"): ["z"], ("e.ts", "E"): ["w", "x"]}


def test_groups_join_what_edges_join(spark):
    import random

    r = random.Random(5)
    edges = [(f"{b}/{r.randrange(12)}", f"{b}/{r.randrange(12)}") for b in range(40) for _ in range(14)] + [(f"c{i}", f"c{i + 1}") for i in range(300)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    made = spark.createDataFrame(edges, "source string, target string")
    found = graph.in_groups(spark.createDataFrame([(x,) for x in parent], "path string"), graph.groups(made), "path").collect()
    tops = {(top(x.path), x.group) for x in found}
    assert len(found) == len(parent) and len(tops) == len({t for t, _ in tops}) == len({g for _, g in tops})


def test_components_of_long_rings_and_by_labels(spark):
    ring = [(f"r{i:04}", f"r{(i + 1) % 900:04}") for i in range(900)]  # more hops than the rounds of labels
    edges = spark.createDataFrame([*ring, ("r0000", "x"), ("x", "x"), ("y", "r0001"), ("a", "b"), ("b", "a")], "source string, target string")
    wanted = sorted([(a, "r0899") for a, _ in ring] + [("x", "x"), ("a", "b"), ("b", "b")])
    assert rows(graph.on_cycles(edges).select("path", "component")) == sorted(wanted, key=repr)
    some = edges.where("source < 'r0000' or source > 'r0895' or source in ('x', 'y')")
    assert rows(graph.on_cycles(some, whole=2)) == rows(graph.on_cycles(some)) == [("a", "b"), ("b", "b"), ("x", "x")]


def test_closure_by_groups_is_that_of_hops(spark):
    import random

    r = random.Random(9)
    edges = spark.createDataFrame(sorted({(f"{b}/{r.randrange(9)}", f"{b}/{r.randrange(9)}") for b in range(6) for _ in range(14)}), "source string, target string")
    seeds = edges.select("source").distinct().toDF("path").union(spark.createDataFrame([("none",), ("0/0",)], "path string"))
    for reverse in (False, True):
        hops = rows(graph.closure(edges, seeds, reverse))
        assert rows(graph.closure(edges, seeds, reverse, few=0)) == hops and len(hops) > 100
        assert rows(graph.closure(edges, seeds, reverse, few=0, most_walks=90)) == hops
    chain = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(230)], "source string, target string")  # deeper than the rounds of hops
    assert graph.closure(chain, chain.select("source").toDF("path")).count() == 231 * 230 // 2


def test_signature_reads_shapes_once(spark):
    sources, asked = counted(spark, SHAPED)
    again = spark.createDataFrame(SHAPED, "path string, content string")
    assert plans.signature(plans.build(sources)).first() == plans.signature(plans.build(again)).first() and asked.value <= 6 * len(SHAPED)


def test_a_text_is_searched_once_for_imports(spark):
    sources = spark.createDataFrame([*SHAPED, ("m.ts", "import d, { type T, U as V } from \"./s';\nexport * from './p'; import('./t')")], "path string, content string")
    found = imports.occurrences(sources)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [tuple(r)[1:] for r in found.where("path = 'm.ts'").orderBy("pos").collect()] == [(0, "./s", "import d, { type T, U as V } from ", "runtime"), (1, "./p", "export * from ", "runtime"), (2, "./t", "import(", "runtime")]
    assert plans.summary(plans.build(sources)).first().type_shapes == 4
