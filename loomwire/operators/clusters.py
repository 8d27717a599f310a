"""Topic clusters: canonical topics, membership, qualification, representatives, flags."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.functions.text import hash_id, strip


def canonical_topic(topic: Column, aliases: Sequence[tuple[str, Sequence[str]]], *texts: Column) -> Column:
    """The first alias of which a keyword occurs, as it is written, in the topic or a text (title, summary), else the trimmed topic."""
    found = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (topic, *texts)))
    out = strip(F.coalesce(topic, F.lit("")))
    for name, keywords in reversed(aliases):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | found.contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def reports(rows: DataFrame) -> DataFrame:
    """rows that aren't near copies of others; all where nothing tells."""
    return rows.filter(F.col("duplicate_of").isNull()) if "duplicate_of" in rows.columns else rows


def with_clusters(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """rows with cluster_id and cluster_size where two reports or more share a topic; near copies neither count nor get them."""
    rows = rows.drop("cluster_id", "cluster_size")
    sizes = clusters(rows, topic).select(F.col(topic).alias("_topic"), F.col("cluster_id").alias("_id"), F.col("n").alias("_n"))
    named = rows.join(sizes, rows[topic] == sizes["_topic"], "left")
    own = F.col("duplicate_of").isNull() if "duplicate_of" in rows.columns else F.lit(True)
    return named.withColumn("cluster_id", F.when(own, F.col("_id"))).withColumn("cluster_size", F.when(own, F.col("_n"))).drop("_topic", "_id", "_n")


def clusters(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """topic, cluster_id, n, n_sources of topics with two reports or more."""
    own = reports(rows).filter(F.coalesce(F.col(topic), F.lit("")) != "")
    counted = own.groupBy(topic).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources")).filter("n > 1")
    return counted.select(topic, hash_id(F.col(topic), 8).alias("cluster_id"), "n", "n_sources")


def qualifying(rows: DataFrame, least: int = 2, large: int = 4, peak: int = 8, limit: int = 25) -> DataFrame:
    """Clusters worth a digest: of `least` members, and large or with a high score; the best `limit`."""
    own = reports(rows).filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("score").alias("peak"))
    return own.filter((F.col("n") >= least) & ((F.col("n") >= large) | (F.col("peak") >= peak))).orderBy(F.desc("peak"), F.desc("n"), F.desc("cluster_id")).limit(limit)


def signatures(rows: DataFrame, n: int = 12, chunk: int = 1 << 20) -> DataFrame:
    """cluster_id and the digest of it and its members' ids in order; rows without an id don't count.

    No cluster is gathered: rows are sorted by cluster and id over all tasks, each of which joins the ids of a cluster
    to chunks of `chunk` bytes; the chunks of a cluster, in order, are fed to its digest one by one.
    """

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, size, done = None, [], 0, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["cluster_id", "first", "ids"])
        for b in batches:
            for key, id_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (key != at or size >= chunk):
                    done.append((at, ids[0], "|".join(ids)))
                    ids, size = [], 0
                at = key
                ids.append(id_)
                size += len(id_) + 1
            if done:
                yield rows()
                done = []
        if ids:
            done.append((at, ids[0], "|".join(ids)))
            yield rows()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, md5, done = None, None, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["cluster_id", "signature"])
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != at:
                    if md5:
                        done.append((at, md5.hexdigest()[:n]))
                    at, md5 = key, hashlib.md5(key.encode(), usedforsecurity=False)
                md5.update(f"|{ids}".encode())
            if done:
                yield rows()
                done = []
        if md5:
            done.append((at, md5.hexdigest()[:n]))
            yield rows()

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = rows.filter("cluster_id IS NOT NULL AND id IS NOT NULL").select(F.col("cluster_id").cast("string"), F.col("id").cast("string"))
    chunks = own.repartitionByRange(tasks, "cluster_id", "id").sortWithinPartitions("cluster_id", "id").mapInArrow(join_ids, "cluster_id string, first string, ids string")
    return chunks.repartition(tasks, "cluster_id").sortWithinPartitions("cluster_id", "first").mapInArrow(digest, "cluster_id string, signature string")


def representatives(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row of each cluster in the given order; rows without a cluster pass."""
    key = F.coalesce(F.col("cluster_id"), F.concat(F.lit("row:"), F.col("id")))
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


#: What the flags look for in title, summary, topic and event type, and the flags, in this order.
FLAG_PATTERNS = (
    ("消息未證實", "據悉|消息指|消息人士|有傳|傳出|網傳|未證實|暫未證實|據報"),
    ("仍有變數", "或|可能|料|預計|估計|相信|未知|暫未|變數"),
)
THIN, ONE_SOURCE, NO_SUMMARY = "全文不足", "單一來源", "AI摘要缺失"
FLAG_FIELDS = ("title", "summary", "topic", "event_type")


def uncertainty_flags(rows: DataFrame, patterns: Sequence[tuple[str, str]] = FLAG_PATTERNS, most: int = 3) -> DataFrame:
    """rows with flags: patterns found, thin content, an important story of one source, no summary; the first `most`.

    rows has title, summary, score, source, cluster_id, chars (of the content) and, if known, topic, event_type, fallback
    and duplicate_of. Content is thin below 500 characters or where only a minimal page was made. Near copies are
    no sources; a story without a cluster has one.
    """
    found = F.concat_ws(" ", *(F.col(c) for c in FLAG_FIELDS if c in rows.columns))
    counts = reports(rows).filter("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("_cluster")).agg(F.count_distinct(F.coalesce("source", F.lit(""))).alias("_sources"))
    out = rows.join(counts, rows["cluster_id"] == counts["_cluster"], "left")
    sources = F.when(F.col("cluster_id").isNull(), 1).otherwise(F.coalesce("_sources", F.lit(0)))
    thin = F.col("chars") < 500
    if "fallback" in rows.columns:
        thin = thin | F.coalesce(F.col("fallback") == "minimal", F.lit(False))
    flags = [F.when(found.rlike(p), F.lit(name)) for name, p in patterns]
    flags += [F.when(thin, F.lit(THIN)), F.when((F.col("score") >= 7) & (sources < 2), F.lit(ONE_SOURCE)), F.when(F.coalesce("summary", F.lit("")) == "", F.lit(NO_SUMMARY))]
    return out.withColumn("flags", F.slice(F.array_distinct(F.array_compact(F.array(*flags))), 1, most)).drop("_cluster", "_sources")
