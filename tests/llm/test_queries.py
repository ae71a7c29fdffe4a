"""The queries that SQL can say, against their DuckDB SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from quirelight.llm import queries

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def views():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con



@there
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), views().sql(queries.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    norm = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[names].astype(object).values.tolist()), key=str)
    assert norm(got) == norm(want)


@there
def test_held_out_languages(spark):
    found = queries.QUERIES["op2_langid"](spark, SF.replace("0.001", "0.01")).where("held_out")
    true = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    both = found.join(true, "doc_id").toPandas()
    assert (both["lang_pred"] == both["lang"]).mean() > 0.97


@there
def test_held_out_toxicity(spark):
    sf = SF.replace("0.001", "0.1")
    found = queries.QUERIES["op1_toxicity"](spark, sf).where("held_out")
    both = found.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    hit = (both["predicted"] == 1) & (both["toxic"] == 1)
    assert hit.sum() >= 0.85 * (both["toxic"] == 1).sum() and hit.sum() >= 0.85 * (both["predicted"] == 1).sum()
