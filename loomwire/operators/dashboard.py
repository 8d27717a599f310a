"""Blocks that pages are composed of: facts, cluster summaries, indicators, expansions, mixed recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facets, rank, search


def facts(event_type: Column, entities: Column, each: int = 4, most: int = 14) -> Column:
    """The type, then up to `each` values of every kind of entity, `most` in all."""
    pair = lambda k: F.transform(F.slice(F.coalesce(entities[k], F.array().cast("array<string>")), 1, each), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    own = F.filter(F.array(F.struct(F.lit("type").alias("kind"), event_type.alias("value"))), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return F.slice(F.concat(own, *(pair(k) for k in ("people", "companies", "places", "dates", "numbers"))), 1, most)


def alert_reason(is_breaking: Column, score: Column, flags: Column) -> Column:
    return F.when(is_breaking, "breaking").when(score >= 8, "important").otherwise(F.coalesce(F.get(flags, F.lit(0)), F.lit("")))


def expand(rows: DataFrame, cluster_id: str) -> DataFrame:
    """All rows of a cluster, newest first."""
    return rows.filter(F.col("cluster_id") == cluster_id).orderBy(F.desc("ts"), "id")


def indicators(digests: DataFrame) -> DataFrame:
    """cluster_id with whether its digest has a timeline of two rows and any contradiction."""
    n = lambda c: F.coalesce(F.size(F.col(f"digest.{c}")), F.lit(0))
    return digests.select("cluster_id", (n("timeline") >= 2).alias("has_timeline"), (n("contradictions") > 0).alias("has_contradiction"))


def card_indicators(rows: DataFrame, digests: DataFrame, breaking: DataFrame) -> DataFrame:
    """id and what a row's card shows: cluster stack, breaking, timeline, contradiction. Rows outside clusters of two or more show none."""
    found = rows.join(indicators(digests), "cluster_id", "left").join(breaking.select("cluster_id", F.lit(True).alias("_breaking")).distinct(), "cluster_id", "left")
    stack = F.coalesce((F.col("cluster_size") > 1) & F.col("cluster_id").isNotNull(), F.lit(False))
    shown = lambda c: stack & F.coalesce(F.col(c), F.lit(False))
    return found.select("id", stack.alias("stack"), shown("_breaking").alias("breaking"), shown("has_timeline").alias("timeline"), shown("has_contradiction").alias("contradiction"))


def recency_step(ts: Column, now: Column) -> Column:
    """2 within the hour, 1 within three, 0.5 within six, else 0."""
    age = rank.age_hours(ts, now)
    return F.when(age < 1, 2.0).when(age < 3, 1.0).when(age < 6, 0.5).otherwise(0.0)


def hot_list(rows: DataFrame, least: int = 5) -> DataFrame:
    """Rows of at least that score, and breaking ones."""
    return rows.filter((F.col("score") >= least) | F.coalesce("is_breaking", F.lit(False)))


def preset(rows: DataFrame, tab: str) -> DataFrame:
    """What a tab starts with: home all rows, hot the important ones, without any other filter."""
    return search.list_filter(rows, important=tab == "hot")


def navigation(rows: DataFrame, session: DataFrame, current: str) -> DataFrame:
    """id, position: the session's list (id, position) if it has the current row, else the snapshot's order (ord)."""
    own = session.select("id", F.col("position").cast("long").alias("position"))
    known = F.broadcast(own.agg(F.coalesce(F.max(F.col("id") == current), F.lit(False)).alias("known")))
    snapshot = rank.numbered(rows.select("id", "ord"), [F.col("ord").asc()]).select("id", "position")
    return own.join(known, F.col("known")).select("id", "position").unionByName(snapshot.join(known, ~F.col("known")).select("id", "position"))


def digest_member(nth: Column, source: Column, ts: Column, title: Column, summary: Column) -> Column:
    """One member of a cluster as a digest's prompt lists it."""
    flat = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    day = F.coalesce(F.concat(F.lit("（"), F.date_format(ts, "yyyy-MM-dd"), F.lit("）")), F.lit(""))
    return F.concat(F.lit("### 第 "), nth.cast("string"), F.lit(" 篇\n來源："), F.trim(F.coalesce(source, F.lit(""))), day, F.lit("\n標題："), F.trim(F.coalesce(title, F.lit(""))), F.lit("\n摘要："), flat(summary))


def alert_messages(alerts: DataFrame, base: str, width: int = 120) -> DataFrame:
    """article_id, body, url of the push message of each alert; sending it is the caller's (see streaming.jobs.each_batch)."""
    return alerts.select("article_id", F.substring("headline", 1, width).alias("body"), F.concat(F.lit(base.rstrip("/") + "/article.html?id="), "article_id").alias("url"))


def angle_sentiment(rows: DataFrame, angles: DataFrame) -> DataFrame:
    """(cluster_id, label, sentiment): the first known sentiment among an angle's sources in order; of a source's rows the last counts.

    angles has cluster_id, label and an array of sources.
    """
    last = rows.groupBy("cluster_id", "source").agg(F.max_by("sentiment", "ord").alias("sentiment"))
    each = angles.select("cluster_id", "label", F.posexplode("sources").alias("pos", "source")).join(last, ["cluster_id", "source"], "left")
    known = each.groupBy("cluster_id", "label").agg(F.min_by("sentiment", F.when(F.col("sentiment").isNotNull(), F.col("pos"))).alias("sentiment"))
    return known.withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral")))


def cluster_summary(rows: DataFrame) -> DataFrame:
    """cluster_id, sentiment shares and the first distinct points of all members. rows has cluster_id, sentiment, ord, points."""
    own = rows.filter(F.col("cluster_id").isNotNull())
    points = facets.digest_points(own.withColumn("group", F.col("cluster_id"))).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("nth", "point"))).alias("p"))
    return facets.sentiment_by(own, "cluster_id").join(points.select(F.col("group").alias("cluster_id"), F.transform("p", lambda x: x["point"]).alias("points")), "cluster_id", "left")


def similar_then_related(similar: DataFrame, related: DataFrame, first: int = 4, limit: int = 6) -> DataFrame:
    """(id, other, position): up to `first` vector neighbours, then related rows that aren't among them."""
    a = similar.filter(F.col("nth") <= first).select("id", "other", F.lit(0).alias("kind"), "nth")
    b = related.select("id", "other", "nth").join(a.select("id", "other"), ["id", "other"], "left_anti").select("id", "other", F.lit(1).alias("kind"), "nth")
    return a.unionByName(b).withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("kind", "nth"))).filter(F.col("position") <= limit).select("id", "other", "position")


def forget_old(picks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Recent picks (key, ts) that still count."""
    return picks.filter(F.col("ts") > now - F.make_dt_interval(hours=F.lit(hours)))


def pool(rows: DataFrame, muted: DataFrame, now: Column, max_age: int | None = None) -> DataFrame:
    """Rows that recommendations draw from: not muted, not duplicates, not too old."""
    out = rows.join(muted.select("source").distinct(), "source", "left_anti").filter(F.col("duplicate_of").isNull())
    return out if max_age is None else out.filter(rank.age_hours(F.col("ts"), now) <= max_age)


def failures(stats: DataFrame) -> DataFrame:
    """How many sources (or steps) failed, of how many."""
    return stats.agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("all"))
