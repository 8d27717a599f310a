"""From raw documents to packed training rows: five stages, each over all that the one before kept.

Nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns pass all stages: a
null text counts as empty, a row with a null id is scored by its text and otherwise kept, the columns of the first four
stages are those of their input, whatever their names, and an empty table stays empty. Of ties the operators say
what they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwire.llm import decontaminate, jaccard_join, mixing, packing, quality
from loomwire.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id."""
    return jaccard_join.one_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document comes once for each pass that takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", packing_stage),
]

#: SQL can't express a learned ranking or a tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
