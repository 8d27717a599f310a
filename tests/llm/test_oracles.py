"""Queries of the subpackage that SQL can express, held against DuckDB; all queries run."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomwire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    theirs = c.sql(ORACLE_SQL[name])
    rows, columns = theirs.fetchall(), theirs.columns
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    pick = lambda rs, names: sorted(repr(tuple(r[names.index(n)] for n in order)) for r in rs)
    assert pick([tuple(r) for r in df.collect()], df.columns) == pick(rows, columns)


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
