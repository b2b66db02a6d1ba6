"""The queries that have SQL against DuckDB."""

import os

import duckdb
import pytest

from tessella.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    df, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(str(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
