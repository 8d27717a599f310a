"""Every query that SQL can express, held against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomwire.plans import blocks, catalogue, streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    theirs = duck.sql(catalogue.SQL[name])
    rows, columns = theirs.fetchall(), theirs.columns
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    pick = lambda rs, names: sorted(repr(tuple(r[names.index(n)] for n in order)) for r in rs)
    assert pick(mine, df.columns) == pick(rows, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_blocks_are_in_the_catalogue():
    assert {blocks.feed_rss.__name__, streams.feed_conditional.__name__} <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
