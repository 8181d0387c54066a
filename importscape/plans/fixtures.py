"""Corpora that the queries run on: modules generated from the part table, small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 50
SUFFIXES = {0: ".service", 1: ".component", 2: ".routes", 3: ".util", 4: ".spec"}

#: The small graph: nation k imports nation (a * k + b) mod 25 for each (m, c, a, b) with k mod m = c. It has three
#: strongly connected parts, six simple cycles and six files that nothing imports.
SMALL_RULES = ((2, 0, 10, 17), (2, 0, 6, 19), (3, 1, 11, 18))
SMALL_SUFFIXES = {0: ".service", 1: ".component", 2: ".module", 4: ".util"}
SMALL_NAMES = {8: "main", 24: "server"}


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, base, path, up): one module for each part."""
    k = F.col("k")
    suffix = F.coalesce(F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p])[(k % 10).cast("int")], F.lit(""))
    base = F.when(k == 5, "src/main").when(k == 6, "src/server").otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/p"), k, suffix))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_type")
    return parts.select("k", base.alias("base")).select("k", "base", F.concat("base", F.lit(".ts")).alias("path"), F.when(k.isin(5, 6), "./").otherwise("../").alias("up"))


def types(k) -> F.Column:
    """Declarations of a module: an interface, which but for every fifth extends that of the module before, and an alias with more."""
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    parent = F.when(k % 5 != 0, said(" extends S", k - 1)).otherwise("")
    body = said(" {\n  id: number;\n  readonly size", k % 7, "?: string;\n  owner: { name: string; tag", k % 3, ": string };\n  [key: string]: unknown;\n  load(at: number): void;\n}\n")
    return said("export interface S", k, parent, body, "export type A", k, " = S", k, " & { note?: string };\nexport type P", k, " = Partial<A", k, ">;\n")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the generated modules; each imports up to three modules of its block of fifty, uses them and declares types."""
    k, made = F.col("k"), modules(spark, sf_dir)
    # a fourth import of some repeats the second, not for types alone
    turn = F.when(F.col("i") == 4, 2).otherwise(F.col("i"))
    target = (F.floor(k / BLOCK) * BLOCK + (k % BLOCK * 3 + 17 * turn + 1) % BLOCK).cast("long")
    wanted = made.select("*", F.explode(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), lambda i: (i <= k % 4) | (i == 4) & (k % 8 == 7))).alias("i")).withColumn("t", target)
    named = wanted.join(made.select(F.col("k").alias("t"), F.col("base").alias("to")), "t")
    raw, name = F.concat("up", F.substr("to", F.lit(5))), F.concat(F.lit("T"), F.col("t"))
    text = F.when(F.col("i").isin(1, 4), F.concat(F.lit("import {"), name, F.lit("} from '"), raw, F.lit("';\n"))).when(F.col("i") == 2, F.concat(F.lit("import type {\n  "), name, F.lit("\n} from \""), raw, F.lit("\";\n"))).otherwise(F.concat(F.lit("export * from '"), raw, F.lit("';\n")))
    # what the first import brings in is called, made or typed, by k; what the second does is typed
    made_of = F.when(k % 3 == 0, F.concat(name, F.lit("();\n"))).when(k % 3 == 1, F.concat(F.lit("new "), name, F.lit("();\n"))).otherwise(F.concat(F.lit("let a: "), name, F.lit(";\n")))
    use = F.when(F.col("i") == 1, made_of).when(F.col("i") == 2, F.concat(F.lit("let b: "), name, F.lit(";\n"))).otherwise("")
    lines = named.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", text.alias("x")))), lambda s: s.x), "").alias("lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", use.alias("x")))), lambda s: s.x), "").alias("uses"))
    extra = F.concat(F.when(k % 3 == 0, "import { Kit } from '@vendor/kit';\n").otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("import './missing"), k, F.lit("';\n"))).otherwise(""))
    content = F.concat(F.lit("// import { Gone } from './gone';\n"), F.coalesce("lines", F.lit("")), extra, F.lit("export class T"), k, F.lit(" {}\n"), F.coalesce("uses", F.lit("")), types(k))
    return made.join(lines, "k", "left").select("path", content.alias("content"))


def small_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, raw): one module for each nation, in the folder of its region; raw is how others import it."""
    k = F.col("k")
    name = F.concat(F.lit("n"), k, F.coalesce(F.create_map(*[F.lit(x) for p in SMALL_SUFFIXES.items() for x in p])[(k % 5).cast("int")], F.lit("")))
    for n, given in SMALL_NAMES.items():
        name = F.when(k == n, given).otherwise(name)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("z"), F.col("n_regionkey"), F.lit("/")).alias("folder"))
    return nations.select("k", F.concat(F.lit("src/"), "folder", name, F.lit(".ts")).alias("path"), F.concat(F.lit("../"), "folder", name).alias("raw"))


def small_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the small graph; an import is called, typed or made as (k + t) mod 3 says."""
    made, k, t = small_modules(spark, sf_dir), F.col("k"), F.col("t")
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.when(k % m == c, (a * k + b) % 25).alias("t")) for i, (m, c, a, b) in enumerate(SMALL_RULES)])
    wanted = made.select("k", F.explode(rules).alias("r")).select("k", "r.i", "r.t").where("t is not null and t <> k").join(made.select(F.col("k").alias("t"), "raw"), "t")
    name, kind = F.concat(F.lit("N"), t), (k + t) % 3
    line = F.concat(F.lit("import { "), name, F.lit(" } from '"), F.col("raw"), F.lit("';\n"))
    use = F.when(kind == 0, F.concat(name, F.lit("();\n"))).when(kind == 1, F.concat(F.lit("let v: "), name, F.lit(";\n"))).otherwise(F.concat(F.lit("new "), name, F.lit("();\n")))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", c.alias("x")))), lambda s: s.x), "")
    lines = wanted.groupBy("k").agg(joined(line).alias("lines"), joined(use).alias("uses"))
    own = F.when(k % 2 == 0, F.concat(F.lit("export interface N"), k, F.lit(" { id: number }\n"))).otherwise(F.concat(F.lit("export class N"), k, F.lit(" {}\n")))
    return made.join(lines, "k", "left").select("path", F.concat(F.coalesce("lines", F.lit("")), F.coalesce("uses", F.lit("")), own).alias("content"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): from each nation of customers to the two nations of suppliers it buys most from."""
    from pyspark.sql import Window

    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    items = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    sold = items.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source")), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey")
    totals = sold.groupBy("source", "target").agg(F.sum("l_quantity").alias("q"))
    best = totals.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("q"), "target"))).where("place <= 2")  # 25 nations
    return best.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
