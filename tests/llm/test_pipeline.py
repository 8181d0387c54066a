import os

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from importscape.llm import queries


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        if k == 0:
            assert len(kept & toxic) <= 0.3 * len(toxic)
        if name == "mixing":
            assert kept == ids
        ids = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    wanted = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == wanted


def test_odd_documents_pass_every_stage(spark, odd, tmp_path, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == odd.count()


@pytest.mark.parametrize("empty", [True, False])
def test_stages_one_after_the_other(spark, odd, documents, tmp_path, sf_dir, empty):
    """On an empty table, and on odd rows: each stage reads what the one before it wrote."""
    docs = documents([]) if empty else odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0 if empty else docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        result = c.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_queries_cover_their_tables(spark, sf_dir):
    n = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    assert queries.queries()["op2_extract"](spark, sf_dir).count() == n("pages")
    assert queries.queries()["op5_simhash"](spark, sf_dir).count() == n("documents")
    assert {x.split("_")[0] for x in queries.queries()} == {f"op{i}" for i in range(1, 11)}
