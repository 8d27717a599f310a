"""What the library writes: JSON lines, slim indexes, RSS, content tables, vectors and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.functions.dates import rfc822
from loomwire.functions.text import escape_xml

HEAVY = ("content", "rss_content")
SLIM = ("id", "title", "url", "ts", "source")


def light(rows: DataFrame) -> DataFrame:
    """rows without their heavy columns."""
    return rows.drop(*HEAVY)


def slim(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in SLIM if c in rows.columns))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def rss_items(rows: DataFrame, limit: int = 50) -> DataFrame:
    """position and item: RSS 2.0 items of the newest rows (title, url, summary, ts, id)."""
    one = lambda c: escape_xml(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s*\n\s*", " "))
    item = F.concat(F.lit("<item><title>"), one("title"), F.lit("</title><link>"), one("url"), F.lit('</link><guid isPermaLink="false">'), one("id"), F.lit("</guid><description>"), one("summary"), F.lit("</description><pubDate>"), rfc822(F.col("ts")), F.lit("</pubDate></item>"))
    top = rows.orderBy(F.desc("ts"), "id").limit(limit)
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(F.desc("ts"), "id")).alias("position"), item.alias("item"))


def rss(rows: DataFrame, title: str, link: str, limit: int = 50) -> str:
    """A whole RSS document; at most `limit` short rows reach the driver."""
    items = "".join(r["item"] for r in rss_items(rows, limit).orderBy("position").collect())
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{esc(title)}</title><link>{esc(link)}</link><description>{esc(title)}</description>{items}</channel></rss>'


def run_metrics(steps: DataFrame) -> DataFrame:
    """Steps (step, started, ended, error) with ok and seconds."""
    return steps.select("step", F.col("error").isNull().alias("ok"), F.round(F.unix_micros("ended") / 1e6 - F.unix_micros("started") / 1e6, 1).alias("seconds"), "error")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def vector_meta(rows: DataFrame, model: str) -> DataFrame:
    """What is said of a file of vectors: model, dimensions, how many."""
    return rows.agg(F.lit(model).alias("model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.count("*").alias("count"))


def similar_rows(neighbours: DataFrame) -> DataFrame:
    """id and the ids of its nearest rows in order, from (vec_id, other, nth)."""
    best = neighbours.groupBy(F.col("vec_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", "other"))).alias("near"))
    return best.select("id", F.transform("near", lambda n: n["other"]).alias("similar"))
