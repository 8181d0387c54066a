from pyspark.sql import functions as F

from importscape.functions import code, paths


def one(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_normalized_folds_and_keeps_what_leads_out(spark):
    cases = {"./a/../b//c.ts": "b/c.ts", "../x": "../x", "": ".", "/a/../../b": "/b", "a/./b/": "a/b", "a/../../b": "../b"}
    for given, wanted in cases.items():
        assert one(spark, paths.normalized("p"), p=given) == wanted


def test_resolved_drops_dots_above_the_root(spark):
    assert one(spark, paths.resolved("p", "i"), p="src/a/b.ts", i="../c/./d") == "src/c/d"
    assert one(spark, paths.resolved("p", "i"), p="b.ts", i="../../d") == "d"
    assert one(spark, paths.resolved("p", "i"), p="src/b.ts", i="kit") == "kit"


def test_candidates(spark):
    assert len(one(spark, paths.candidates("p"), p="src/x")) == 9
    assert one(spark, paths.candidates("p"), p="src/x.js") == ["src/x.js"]


def test_source_and_test_names(spark):
    assert one(spark, paths.is_source("p"), p="a/d.ts") and not one(spark, paths.is_source("p"), p="a/x.d.ts")
    assert one(spark, paths.is_test("p"), p="a/x.spec.tsx") and not one(spark, paths.is_test("p"), p="a/spec.ts")
    assert one(spark, paths.is_ignored("p"), p="a/node_modules/b.ts") and one(spark, paths.is_ignored("p"), p=".x/b.ts") and not one(spark, paths.is_ignored("p"), p="out.ts")


def test_the_two_classifiers_differ(spark):
    assert one(spark, paths.node_type("p", F.lit("")), p="src/app.config.ts") == "Other"
    assert one(spark, paths.topology_type("p"), p="src/app.config.ts") == "Module"


def test_inside_raises(spark):
    assert one(spark, paths.inside("/r", "p"), p="a/../b") == "/r/b"
    try:
        one(spark, paths.inside("/r", "p"), p="../b")
        raise AssertionError("a target outside of the root passed")
    except Exception as e:
        assert "must stay inside" in str(e)


def test_import_nature_keeps_known_quirks(spark):
    cases = {"import type { A } from ": "type_only", "import { type A, type B } from ": "type_only", "import { type A, b } from ": "runtime", "import D, { type T } from ": "type_only", "export * from ": "runtime"}
    for given, wanted in cases.items():
        assert one(spark, code.import_nature("s"), s=given) == wanted


def test_comments_go_also_inside_strings(spark):
    assert one(spark, code.without_comments("s"), s="let a = 'http://x';\n/* b\n */c") == "let a = 'http:\nc"


def test_imported_symbols(spark):
    cases = {
        "import { Wheel, Axle } from ": ["Wheel", "Axle"], "import chassis, { Motor as Engine } from ": ["Engine", "chassis"], "import * as tyres from ": ["tyres"],
        "import type { Gear } from ": ["Gear"], "import ": [],
    }
    for given, wanted in cases.items():
        assert one(spark, code.imported_symbols("s"), s=given) == wanted


def test_usage_takes_the_strongest(spark):
    text = "@Mark()\nclass Car extends Frame implements Moves { load!: Cargo; drive() { Spark(); road.go(); return new Trip(); } }\nlet l: Promise<Late>; <View />; <Cast>l;"
    cases = {"Mark": "decorator(Mark)", "Trip": "instantiated(Trip)", "Cargo": "typed(Cargo)", "Spark": "called(Spark)", "road": "namespace_access(road)", "Frame": "inherited(Frame)", "Moves": "inherited(Moves)", "Late": "typed(Late)", "View": "jsx_component(View)", "Cast": "typed(Cast)", "x y": None, "Nope": None}
    for symbol, wanted in cases.items():
        assert one(spark, code.usage("s", F.lit(text)), s=symbol) == wanted
    assert one(spark, code.basic_usage("s", F.lit(text)), s="Frame") is None


def test_rules_that_generated_files_do_not_reach(spark):
    kinds = {"a/main.server.ts": "ssr_bootstrap", "entry.server.js": "ssr_bootstrap", "entry.client.ts": "browser_bootstrap", "x/bootstrap.ts": "app_bootstrap", "main.tsx": "none"}
    for path, kind in kinds.items():
        assert one(spark, paths.entrypoint("p"), p=path).kind == kind
    by_text = {"@Injectable() class A {}": "Service", "@Component({}) class A {}": "Component", "class A {}": "Other"}
    for text, kind in by_text.items():
        assert one(spark, paths.node_type("p", F.lit(text)), p="src/a.ts") == kind
    assert one(spark, paths.node_type("p", F.lit("")), p="src/my-helper.ts") == "Helper"
    assert one(spark, paths.topology_type("p"), p="src/utils/a.ts") == "Helper"


def test_jsonc(spark):
    assert one(spark, code.without_jsonc_extras("s"), s='{ /* x */\n // y\n "a": [1,],\n}').split() == ["{", '"a":', "[1]", "}"]


def test_jsonc_on_the_driver_is_the_same(spark):
    text = '// a\n// b\n{ "u": "http://x", /* y\n */ "a": [1, 2, ],\n  // z\n}'
    assert code.plain_json(text) == one(spark, code.without_jsonc_extras("s"), s=text)
