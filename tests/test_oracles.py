"""Every query of the dependency graph against its SQL in DuckDB."""

import os

import duckdb
import pytest

from importscape.plans import oracles, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def same(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, queries.queries()[name], oracles.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
