"""The registered queries against their DuckDB SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from quirelight.plans import apparatus, oracle, queries

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def rows(df):
    import pandas as pd

    names = sorted(df.columns)
    return sorted((tuple(None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in df[names].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@there
@pytest.mark.parametrize("name", sorted({**oracle.SQL, **apparatus.SQL}))
def test_query_matches_sql(spark, duck, name):
    query, sql = {**queries.QUERIES, **apparatus.QUERIES}[name], {**oracle.SQL, **apparatus.SQL}[name]
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@there
def test_entry(spark):
    assert entry.entry(spark).columns == ["volume_id", "para", "first_pos", "last_pos", "level", "text"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
