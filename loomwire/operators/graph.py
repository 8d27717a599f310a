"""Entity graph, entity rankings and the calendar of announced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.functions.text import strip

from .clusters import reports


def nodes(mentions: DataFrame, least: int = 2, limit: int = 150, ids: int = 20) -> DataFrame:
    """type, label, mentions (repeats count), articles, ids (the first `ids` articles); the most mentioned first.

    Articles are listed for the nodes that stay alone, and no more than `ids` of each are gathered.
    """
    own = reports(mentions).filter(F.length("label") >= 2)
    counts = own.groupBy("type", "label").agg(F.count("*").alias("mentions"), F.count_distinct("article").alias("articles"))
    top = counts.filter(F.col("mentions") >= least).orderBy(F.desc("mentions"), F.desc("label"), F.desc("type")).limit(limit)
    listed = own.join(F.broadcast(top.select("type", "label")), ["type", "label"], "left_semi").select("type", "label", "article").distinct()
    nth = F.row_number().over(Window.partitionBy("type", "label").orderBy("article"))
    listed = listed.withColumn("nth", nth).filter(F.col("nth") <= ids).groupBy("type", "label").agg(F.array_join(F.array_sort(F.collect_list("article")), ",").alias("ids"))
    return top.join(listed, ["type", "label"]).orderBy(F.desc("mentions"), F.desc("label"), F.desc("type"))


def edges(mentions: DataFrame, kept: DataFrame, least: int = 2, limit: int = 300, ids: int = 10) -> DataFrame:
    """a, b, weight, articles: unordered pairs of kept nodes by the number of articles that mention both, with the first `ids` of these.

    Only kept nodes are paired, and pairs are made inside each article's own short list, so no join multiplies rows.
    """
    named = reports(mentions).join(kept.select("type", "label"), ["type", "label"], "left_semi")
    lists = named.groupBy("article").agg(F.array_sort(F.collect_set(F.concat_ws(":", "type", "label"))).alias("ends"))
    pairs = lists.select("article", F.explode(F.flatten(F.transform("ends", lambda a, i: F.transform(F.slice("ends", i + 2, F.size("ends")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("pair"))
    pairs = pairs.select("article", "pair.a", "pair.b")
    top = pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least).orderBy(F.desc("weight"), "a", "b").limit(limit)
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("article"))
    first = pairs.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_semi").withColumn("nth", nth).filter(F.col("nth") <= ids)
    listed = first.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("article")), ",").alias("articles"))
    return top.join(listed, ["a", "b"]).orderBy(F.desc("weight"), "a", "b")


def top_entities(mentions: DataFrame, least: int = 3, limit: int = 20) -> DataFrame:
    """type, label, articles: the entities of most distinct articles, `limit` of each type. Near copies and names under two characters don't count."""
    named = reports(mentions).withColumn("label", strip("label")).filter(F.length("label") >= 2)
    own = named.groupBy("type", "label").agg(F.count_distinct("article").alias("articles")).filter(F.col("articles") >= least)
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("articles"), "label"))).filter(F.col("nth") <= limit)


def drop_reasons(rows: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """How many rows each rule of the entity digest drops, first rule first; rows without entities are told apart and count as ok, too."""
    old = F.col("ts") < now - F.make_dt_interval(hours=F.lit(hours))
    dropped = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("ts").isNull(), "no date").when(old, "old")
    bare = F.when(~F.coalesce("has_entities", F.lit(False)), "no entities")
    reasons = F.when(dropped.isNotNull(), F.array(dropped)).otherwise(F.array_compact(F.array(F.lit("ok"), bare)))
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def calendar(announced: DataFrame, today: Column, days: int = 90, limit: int = 80, ids: int = 6) -> DataFrame:
    """date, title, articles: announcements of one date and title are one event, the first title stays.

    announced has date, title, article, ord.
    """
    key = F.substring(F.regexp_replace(F.lower("title"), r"(?U)\s", ""), 1, 30)
    own = reports(announced).filter(F.col("date").between(today, F.date_add(today, days))).withColumn("key", key)
    each = own.groupBy("date", "key", "article").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    events = each.groupBy("date", "key").agg(F.min_by("title", "ord").alias("title"), F.count("*").alias("n")).orderBy("date", "title", "key").limit(limit)
    nth = F.row_number().over(Window.partitionBy("date", "key").orderBy("ord", "article"))
    first = each.join(F.broadcast(events.select("date", "key")), ["date", "key"], "left_semi").withColumn("nth", nth).filter(F.col("nth") <= ids)
    listed = first.groupBy("date", "key").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("article").cast("string").alias("article")))).alias("seen"))
    return events.join(listed, ["date", "key"]).select("date", "title", "n", F.array_join("seen.article", ",").alias("articles")).orderBy("date", "title")
