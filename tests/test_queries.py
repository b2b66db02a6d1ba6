"""Every registered query with SQL against DuckDB, on the smallest tables; entry()."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_done_of_all_events(spark, duck):
    """One name in eleven is no archive; all others are done, whatever their day."""
    want = duck.sql("select count(*) filter (event_id % 7 <> 0), count(distinct cast(ts as date)) from events where event_id % 11 <> 0").fetchall()[0]
    assert (queries.done_all_diffs(spark, SMALL).count(), queries.done_all_days(spark, SMALL).count()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
