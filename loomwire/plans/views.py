"""The article-shaped view of the document tables that most operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.storage import table

NOW = "2024-01-31 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and topics are cut before labels are joined, so that whole texts are dealt out only where `content` is used."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(43200)).cast("int")
    cut = d.select(
        F.col("doc_id").alias("ord"),
        F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12).alias("id"),
        F.substring("text", 1, 80).alias("title"),
        "source",
        F.col("lang").alias("category"),
        (at("2024-01-01 00:00:00") + F.make_dt_interval(mins=minutes)).alias("ts"),
        (1 + F.pmod(F.col("doc_id") * 31, F.lit(10))).cast("int").alias("score"),
        F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("topic"),
        F.col("text").alias("content"),
    )
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("sentiment")
    return cut.join(labels.withColumnRenamed("doc_id", "ord"), "ord", "left").select("ord", "id", "title", "source", "category", "ts", "score", "topic", sentiment, "content")


ARTICLES = """a AS (
  SELECT doc_id AS ord, substr(md5(doc_id::VARCHAR), 1, 12) AS id, substr(text, 1, 80) AS title, source, lang AS category,
    TIMESTAMP '2024-01-01' + to_minutes(((doc_id * 7919) % 43200)::INT) AS ts, (1 + (doc_id * 31) % 10)::INT AS score,
    lower(split_part(trim(text), ' ', 1)) AS topic,
    CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment, text AS content
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles: the type is the cluster, the user the source, the value the score."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("source"), F.col("value").cast("int").alias("score"), "ts")


EVENTS = "e AS (SELECT event_id AS ord, event_id::VARCHAR AS id, event_type AS topic, user_id::VARCHAR AS source, trunc(value)::INT AS score, ts FROM events)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions: an order is an article, its lines mention brands, suppliers and nations."""
    get = lambda n: table(spark, sf_dir, n)
    rows = (
        get("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        .join(get("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(get("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(get("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(get("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    kinds = F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).alias("label")) for k, c in (("people", "p_brand"), ("companies", "s_name"), ("places", "n_name"))))
    return rows.select(F.col("l_orderkey").alias("article"), F.col("o_orderdate").alias("ts"), F.inline(kinds))


MENTIONS = """m AS (
  SELECT l_orderkey AS article, o_orderdate AS ts, k.type, CASE k.type WHEN 'people' THEN p_brand WHEN 'companies' THEN s_name ELSE n_name END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey,
    (VALUES ('people'), ('companies'), ('places')) k(type)
)"""
ORDERS_NOW, ORDERS_TODAY = "2001-08-01 00:00:00", "2001-05-01"
