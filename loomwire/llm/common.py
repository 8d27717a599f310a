"""The library's storage and small helpers, for the operators in this subpackage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.storage import bounded, forget, shared_dir, table, written

__all__ = ["any_names", "ascii_lower", "bounded", "fold", "forget", "map_rows", "plain_names", "shared_dir", "small_batches", "table", "written"]

#: A word of the contracts: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that one Arrow batch may hold; with long texts a batch stays a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def map_rows(df: DataFrame, function) -> DataFrame:
    """mapInArrow over all columns of df, whatever their names (dots, repeats); function sees c0, c1, ... and returns them."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(function, plain.schema).toDF(*df.columns)


def plain_names(df: DataFrame, *keep: str) -> DataFrame:
    """df whose columns other than `keep` are called extra_0, extra_1, ...: any names of a caller's columns are safe then."""
    first = [c in keep and df.columns.index(c) == i for i, c in enumerate(df.columns)]
    return df.toDF(*(c if own else f"extra_{i}" for i, (c, own) in enumerate(zip(df.columns, first, strict=True))))


def any_names(*keep: str):
    """For a function that gives its first argument's columns back: callers' columns may have any names (dots, repeats, its own)."""

    def wrap(stage):
        @functools.wraps(stage)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            return stage(plain_names(docs, *keep), *args, **options).toDF(*docs.columns)

        return run

    return wrap


def fold(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by
