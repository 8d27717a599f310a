"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, fingerprint, jaccard_join, language_id, mixing, packing, partial_distance, quality, secret_scan, token_counts, url_filter, warc
from .common import table


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_jaccard_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_url_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.fit(docs))


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "shard_again")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op8_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.Vocabulary.load())


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_distance.compress(table(spark, sf_dir, "embeddings"))


def op13_suffix_sigma_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_bradley_terry,
        op2_jaccard_pivot_join,
        op3_url_shift_and,
        op4_language_centroids,
        op5_canonical_digest,
        op6_mixing_splitting_tree,
        op7_warc_derivatives,
        op8_viterbi_token_counts,
        op9_best_fit_packing,
        op10_template_decontamination,
        op11_secret_guess_cost,
        op12_partial_distance_codes,
        op13_suffix_sigma_phrases,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_pivot_join": jaccard_join.ORACLE_SQL,
    "op3_url_shift_and": url_filter.ORACLE_SQL,
    "op6_mixing_splitting_tree": mixing.oracle_sql(),
    "op10_template_decontamination": decontaminate.oracle_sql(),
    "op12_partial_distance_codes": partial_distance.oracle_sql(),
    "op13_suffix_sigma_phrases": collocations.ORACLE_SQL,
}
