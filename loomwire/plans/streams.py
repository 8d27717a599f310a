"""Queries that replay tables as streams or keep state from batch to batch, with the SQL that gives the same rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.operators import trends
from loomwire.sources import payload
from loomwire.sources.conditional import ConditionalFeeds, validators
from loomwire.sources.tables import KeyedTable, carry_over
from loomwire.storage import shared_dir, table
from loomwire.streaming.jobs import each_batch

from .catalogue import over_articles, query
from .views import EVENTS, NOW, articles, at, events, iso


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_dir(spark)}/loomwire/{name}-{uuid4().hex}"


# Conditional feeds: each source is a feed whose body is its latest article of a poll; validators stay for two polls

_POLLS = """, s AS (SELECT source AS feed, (ord // 100) + 1 AS poll, max(ord) AS ord FROM a GROUP BY ALL),
r AS (SELECT feed, poll, CASE WHEN (poll + length(feed)) % 5 = 0 THEN 503 ELSE 200 END AS status, 'v' || (poll // 2) AS etag, ord FROM s),
ok AS (SELECT *, lag(etag) OVER (PARTITION BY feed ORDER BY poll) AS had FROM r WHERE status = 200),
t AS (SELECT r.feed AS source, r.poll, r.status, ok.etag, ok.etag IS NOT DISTINCT FROM ok.had AND ok.etag IS NOT NULL AS same, r.ord FROM r LEFT JOIN ok USING (feed, poll))"""


def landed_responses(spark: SparkSession, sf_dir: str) -> str:
    """Writes the table of responses in the order of their polls; its folder."""
    poll = (F.floor(F.col("ord") / 100) + 1).cast("long")
    # as articles() has them, without the join of labels, which changes no maximum
    a = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"))
    r = a.filter("source IS NOT NULL").groupBy(F.col("source").alias("feed"), poll.alias("poll")).agg(F.max("ord").alias("ord"))
    down = F.pmod(F.col("poll") + F.length("feed"), F.lit(5)) == 0
    body = F.concat(F.lit("<rss><channel><item><title>"), F.col("ord").cast("string"), F.lit("</title></item></channel></rss>"))
    told = r.select("feed", "poll", F.when(down, 503).otherwise(200).alias("status"), F.concat(F.lit("v"), F.floor(F.col("poll") / 2).cast("string")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), body.alias("body"))
    path = fresh_dir(spark, "responses")
    told.repartitionByRange("poll").sortWithinPartitions("poll", "feed").write.parquet(path)
    return as_uri(path)


def polled(spark: SparkSession, responses: str, checkpoint: str | None = None, name: str | None = None) -> DataFrame:
    """All rows that the stream of these responses gives until nothing is due."""
    spark.dataSource.register(ConditionalFeeds)
    name = name or f"polls_{uuid4().hex}"
    out, at = fresh_dir(spark, name), checkpoint or fresh_dir(spark, f"{name}-checkpoint")
    stream = spark.readStream.format("conditional_feeds").option("responses", responses).load()
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(out)


@query(over_articles(_POLLS + """ SELECT source, poll, CASE WHEN same THEN 304 ELSE status END AS status, same AS not_modified, CASE WHEN status >= 400 THEN 'HTTP ' || status END AS error,
  CASE WHEN status = 200 AND NOT same THEN '<rss><channel><item><title>' || ord || '</title></item></channel></rss>' END AS body FROM t WHERE source IS NOT NULL"""))
def feed_conditional(spark, sf_dir):
    return polled(spark, landed_responses(spark, sf_dir)).select("source", "poll", "status", "not_modified", "error", "body")


@query(over_articles(_POLLS + """ SELECT source AS feed, arg_max(etag, poll) FILTER (status = 200) AS etag, arg_max(CASE WHEN same THEN 304 ELSE status END, poll) AS status FROM t WHERE source IS NOT NULL GROUP BY source"""))
def feed_validators(spark, sf_dir):
    return validators(polled(spark, landed_responses(spark, sf_dir))).select("feed", "etag", "status")


# State from batch to batch: events come in four parts

PARTS = 4


def in_parts(spark: SparkSession, rows: DataFrame, part) -> DataFrame:
    """rows as a stream of PARTS micro-batches, by the number that part gives."""
    path = fresh_dir(spark, "parts")
    for k in range(PARTS):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_batches(stream: DataFrame, apply) -> None:
    running = each_batch(stream, apply, fresh_dir(stream.sparkSession, "checkpoint"))
    running.awaitTermination()


@query(f"WITH {EVENTS} SELECT source, arg_max(id, (ts, ord)) AS id, arg_max(topic, (ts, ord)) AS topic, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS ts FROM e GROUP BY source")
def stream_latest_by_source(spark, sf_dir):
    rows = events(spark, sf_dir).select("source", "ord", "id", "topic", "ts")
    state = KeyedTable(spark, fresh_dir(spark, "latest"), rows.schema, ["source"], ["ts", "ord"], 16)

    def apply(batch: DataFrame, number: int) -> None:
        state.upsert(batch, number)
        assert not state.upsert(batch, number)  # a repeated batch changes nothing

    run_batches(in_parts(spark, rows, F.pmod("ord", F.lit(PARTS))), apply)
    return state.read().select("source", "id", "topic", iso("ts").alias("ts"))


@query(over_articles(f""", b AS (SELECT source, ord % {PARTS} AS part, id, ts FROM a WHERE NOT (length(source) % 2 = 0 AND ord % {PARTS} = {PARTS - 1})),
last AS (SELECT source, max(part) AS part FROM b GROUP BY source)
SELECT b.source, b.id, strftime(b.ts, '%Y-%m-%dT%H:%M:%S') AS date FROM b JOIN last USING (source, part) WHERE part = {PARTS - 1} OR ts > TIMESTAMP '{NOW}' - INTERVAL 600 HOUR"""))
def stream_carry_over(spark, sf_dir):
    """Each part is a run; in the last one half of the sources is silent and keeps its fresh rows."""
    rows = articles(spark, sf_dir).filter("source IS NOT NULL").select("source", "ord", "id", F.col("ts").alias("ts"))
    part = F.pmod("ord", F.lit(PARTS))
    rows = rows.filter(~((F.length("source") % 2 == 0) & (part == PARTS - 1)))
    state = KeyedTable(spark, fresh_dir(spark, "carried"), rows.schema, ["source"], ["ts"], 8)
    merge = carry_over(at(NOW) - F.expr("INTERVAL 600 HOURS"))
    for k in range(PARTS):
        state.upsert(rows.filter(part == k), k, merge)
    # buckets without news aren't rewritten, so what has grown old there is left out on reading
    fresh = (part == PARTS - 1) | (F.col("ts") > at(NOW) - F.expr("INTERVAL 600 HOURS"))
    return state.read().filter(fresh).select("source", "id", iso("ts").alias("date"))


# A published payload: rows, statistics of sources and trends, read back


@query(over_articles(" SELECT 'articles' AS section, id AS name, score::BIGINT AS n FROM a UNION ALL SELECT 'stats', source, count(*) FROM a GROUP BY source"))
def published_payload(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stats = rows.groupBy("source").agg(F.count("*").alias("n"))
    uri = as_uri(fresh_dir(spark, "payload"))
    payload.publish(uri, articles=rows.select("id", "title", "score", "content"), stats=stats, trending=trends.trending(rows, at(NOW), hours=168))
    told = payload.read(spark, uri, "articles", "id string, title string, score int, content string")
    assert told.filter("content IS NOT NULL").isEmpty() and payload.current(uri)["sections"]["trending"]
    counted = payload.read(spark, uri, "stats", "source string, n long")
    return told.select(F.lit("articles").alias("section"), F.col("id").alias("name"), F.col("score").cast("long").alias("n")).unionByName(counted.select(F.lit("stats").alias("section"), F.col("source").alias("name"), "n"))
