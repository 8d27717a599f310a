"""Counts for the list's facets and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.storage import bounded


def sentiment_by(rows: DataFrame, key: str = "category") -> DataFrame:
    """Counts and whole percentages; neutral takes what the others leave of 100."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")))
    pct = lambda c: F.floor(100.0 * F.col(c) / F.col("n") + 0.5).cast("long")
    return g.withColumn("positive_pct", pct("positive")).withColumn("negative_pct", pct("negative")).withColumn("neutral_pct", 100 - F.col("positive_pct") - F.col("negative_pct"))


def histogram(rows: DataFrame, value: str, limit: int) -> DataFrame:
    v = F.trim(F.col(value))
    return rows.filter(F.coalesce(v, F.lit("")) != "").groupBy(v.alias(value)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(limit)


def tag_sizes(rows: DataFrame, tags: str = "tags", limit: int = 24) -> DataFrame:
    """The commonest tags and their relative size in a cloud."""
    top = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)
    return top.withColumn("size", F.round(0.78 + F.col("n") / F.max("n").over(Window.partitionBy()) * 0.38, 4))


def top_tags(rows: DataFrame, tags: str = "tags", least: int = 2, limit: int = 10) -> DataFrame:
    """Tags of each category and, under null, of all."""
    g = rows.select("category", F.explode(tags).alias("tag")).groupingSets([["category", "tag"], ["tag"]], "category", "tag").agg(F.count("*").alias("n"), F.grouping("category").alias("all")).filter(F.col("n") >= least)
    nth = F.row_number().over(Window.partitionBy("all", "category").orderBy(F.desc("n"), "tag"))
    return g.withColumn("nth", nth).filter(F.col("nth") <= limit).select("category", "tag", "n", "nth")


def distinct_sources(rows: DataFrame) -> DataFrame:
    return rows.select("category", "source").distinct()


def cluster_focus(rows: DataFrame, digests: DataFrame, limit: int = 5) -> DataFrame:
    """The largest clusters that have a digest."""
    return rows.join(digests.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(limit)


def source_stats(rows: DataFrame, restored: DataFrame) -> DataFrame:
    """Rows of each source, of which restored, and both together."""
    a, b = rows.groupBy("source").agg(F.count("*").alias("n")), restored.groupBy("source").agg(F.count("*").alias("restored"))
    return a.join(b, "source", "full").na.fill(0, ["n", "restored"]).withColumn("effective", F.col("n") + F.col("restored"))


def source_health(stats: DataFrame) -> DataFrame:
    """error, empty, cached or ok, in that rank. stats has source, n, restored, error."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("n") + F.col("restored") == 0, "empty").when(F.col("n") == 0, "cached").otherwise("ok")
    rank = F.when(F.col("health") == "error", 0).when(F.col("health") == "empty", 1).when(F.col("health") == "cached", 2).otherwise(3)
    return stats.withColumn("health", state).withColumn("rank", rank)


def source_history(runs: DataFrame) -> DataFrame:
    """source, fail_streak, last_success, last_error from rows (source, run, error): errors since the last run without one.

    The error is the last run's, up to 120 characters, or empty. Two sums over each source; no history is gathered.
    """
    last_ok = runs.groupBy("source").agg(F.max(F.when(F.col("error").isNull(), F.col("run"))).alias("last_success"))
    met = runs.alias("r").join(bounded(last_ok).alias("k"), F.col("r.source").eqNullSafe(F.col("k.source"))).select("r.*", "last_success")
    since = F.col("last_success").isNull() | (F.col("run") > F.col("last_success"))
    told = F.max_by(F.coalesce(F.substring("error", 1, 120), F.lit("")), "run")
    return met.groupBy("source").agg(F.count_if(since).alias("fail_streak"), F.max("last_success").alias("last_success"), told.alias("last_error"))


def digest_points(rows: DataFrame, points: str = "points", limit: int = 5) -> DataFrame:
    """The first distinct points of a group's summaries, in order: group, nth, point. rows has group, ord and an array of points."""
    each = rows.select("group", "ord", F.posexplode(points).alias("pos", "point")).withColumn("key", F.lower(F.regexp_replace("point", r"(?U)\s", ""))).filter("key <> ''")
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("group", "key").orderBy("ord", "pos"))).filter("_n = 1")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy("ord", "pos"))).filter(F.col("nth") <= limit).select("group", "nth", "point")
