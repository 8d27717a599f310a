"""Trailing-window trends, bursts and alerts. `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.storage import written

from .clusters import reports


def since(ts: str, now: Column, hours: int) -> Column:
    """Inclusive lower bound only: rows dated later than now pass."""
    return F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours))


def fresh(rows: DataFrame, now: Column, hours: int = 30, strict: bool = False, ts: str = "ts") -> DataFrame:
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return rows.filter(F.col(ts) > cutoff if strict else F.col(ts) >= cutoff)


def age_hours(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", ts, now) / 3600.0


def _named(source: str) -> Column:
    return F.when(F.coalesce(F.col(source), F.lit("")) != "", F.col(source))


def first_names(each: DataFrame, keys: DataFrame, key: str, most: int | None = 5) -> DataFrame:
    """key and its first `most` sources in order, None for all, from rows of one key and source; no more than these are gathered."""
    first = each.filter("source IS NOT NULL").join(keys, key, "left_semi").select(key, "source")
    if most is not None:
        nth = F.row_number().over(Window.partitionBy(key).orderBy("source"))
        first = first.withColumn("nth", nth).filter(F.col("nth") <= most)
    return first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"))


def trending(rows: DataFrame, now: Column, hours: int = 4, least: int = 2, limit: int = 10) -> DataFrame:
    """Topics of the window by heat: rows, distinct sources, mean score and recency."""
    recent = rows.filter(since("ts", now, hours) & (F.coalesce(F.col("topic"), F.lit("")) != ""))
    each = recent.groupBy("topic", _named("source").alias("source")).agg(
        F.count("*").alias("n"), F.sum("score").cast("double").alias("total"), F.count("score").alias("scored"), F.max("ts").alias("latest")
    )
    each = written(each, "topic-sources")
    mean = F.when(F.sum("scored") > 0, F.sum("total") / F.sum("scored")).otherwise(5.0)
    g = each.groupBy("topic").agg(F.sum("n").alias("n"), F.count("source").alias("n_sources"), F.round(mean, 1).alias("avg_score"), F.max("latest").alias("latest"))
    g = g.filter(F.col("n") >= least)
    recency = F.greatest(F.lit(0.0), hours - F.greatest(F.lit(0.0), F.least(F.lit(float(hours)), age_hours(F.col("latest"), now))))
    heat = F.round(8 * F.col("n") + 5 * F.col("n_sources") + 3 * F.col("avg_score") + 2 * recency, 2)
    order = (F.desc("heat"), F.desc("n"), F.desc("latest"), "topic")
    top = g.withColumn("heat", heat).orderBy(*order).limit(limit)
    named = first_names(each, F.broadcast(top.select("topic")), "topic")
    out = top.join(named, "topic", "left").orderBy(*order)
    return out.select("topic", "n", "n_sources", F.coalesce("names", F.lit("")).alias("top_sources"), "avg_score", "latest", "heat")


def breaking(rows: DataFrame, now: Column, cluster: str = "cluster_id", hours: int = 2, least: int = 3, most: int | None = 5) -> DataFrame:
    """Clusters that `least` distinct sources reported within the window, with the first `most` of these, None for all; the headline is the best of all members, of equals the first."""
    recent = F.when(since("ts", now, hours), _named("source"))
    order = F.struct(F.coalesce("score", F.lit(0)).alias("score"), "ts", (-F.col("ord")).alias("ord"), "id")
    own = reports(rows).filter(F.col(cluster).isNotNull())
    each = written(own.groupBy(cluster, recent.alias("source")).agg(F.count("*").alias("n"), F.max(order).alias("best")), "cluster-sources")
    g = each.groupBy(cluster).agg(F.max("best")["id"].alias("headline"), F.sum("n").alias("n"), F.count("source").alias("n_sources"))
    found = g.filter(F.col("n_sources") >= least)
    names = first_names(each, found.select(cluster), cluster, most)
    return found.join(names, cluster).select(cluster, "headline", "n", "n_sources", F.col("names").alias("sources"))


def not_yet_alerted(found: DataFrame, state: DataFrame, now: Column, cluster: str = "cluster_id", ttl_hours: int = 48) -> DataFrame:
    """Clusters without an alert that is still remembered."""
    alive = state.filter(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(ttl_hours)))
    return found.join(alive.select(cluster).distinct(), cluster, "left_anti")


def alert_candidates(rows: DataFrame, now: Column, muted: DataFrame | None = None, order: Sequence[Column] | None = None, limit: int = 3) -> DataFrame:
    """Breaking, important, or fresh and flagged; one per cluster, `limit` in all, in the active order of the list (newest first).

    rows has is_breaking and flagged. Rows of muted sources and near copies are left out.
    """
    order = [F.col("ts").desc_nulls_last(), F.col("ord")] if order is None else list(order)
    age = age_hours(F.col("ts"), now)
    own = reports(rows)
    if muted is not None:
        own = own.join(muted.select("source").distinct(), "source", "left_anti")
    score = F.coalesce("score", F.lit(0))
    keep = own.filter(F.col("is_breaking") | (score >= 8) | (F.coalesce(age <= 6, F.lit(False)) & F.col("flagged") & (score >= 7)))
    reason = F.when(F.col("is_breaking"), "breaking").when(score >= 8, "important").otherwise("flagged")
    key = F.coalesce(F.col("cluster_id"), F.concat(F.lit("row:"), F.col("id")))
    one = keep.withColumn("reason", reason).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1")
    return one.orderBy(*order).limit(limit).drop("_nth")
