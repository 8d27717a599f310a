"""Queries of the blocks, sources, sinks and streams that the catalogue has no rows for, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.functions import dates, text
from loomwire.operators import dashboard, rank, state, vectors
from loomwire.sources import feeds, sinks
from loomwire.storage import table

from .catalogue import _CLUSTERED, ISO, _drained, _replay, clustered, over_articles, query
from .views import EVENTS, NOW, articles, at, events, iso

CUT = "2024-01-10 00:00:00"


def _ts(c: str = "ts"):
    return F.col(c).cast("timestamp")


# Feeds: fifty articles in a row make one body, which the reader cuts to thirty items by its own rule

_BODIES = """, u AS (SELECT *, 'feed' || (ord // 50) AS feed, 'https://h/' || category || '/' || id AS url FROM a)"""
_SHOWN = "SELECT substr(md5(url), 1, 12) AS id, url, strftime(ts, {iso}) AS date, feed AS source, {category} AS category FROM {rows}"


def _feed_sql(rows: str, category: str = "NULL::VARCHAR") -> str:
    return over_articles(_BODIES + f", kept AS ({rows}) " + _SHOWN.format(iso=ISO, category=category, rows="kept"))


def _feed(spark, sf_dir, item, begin: str, between: str, end: str):
    """source and body; item makes the text of one article."""
    a = articles(spark, sf_dir).withColumn("url", F.concat(F.lit("https://h/"), "category", F.lit("/"), "id"))
    feed = F.concat(F.lit("feed"), F.floor(F.col("ord") / 50).cast("string"))
    lists = a.select(feed.alias("source"), F.struct("ord", item.alias("item")).alias("i")).groupBy("source").agg(F.array_sort(F.collect_list("i")).alias("items"))
    return lists.select("source", F.concat(F.lit(begin), F.array_join("items.item", between), F.lit(end)).alias("body"))


def _shown(rows):
    return rows.select("id", "url", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "source", "category")


_FIRST = "row_number() OVER (PARTITION BY feed ORDER BY ord) <= 30"


@query(_feed_sql(f"SELECT * FROM (SELECT * FROM u QUALIFY {_FIRST}) WHERE ts >= TIMESTAMP '{CUT}'"))
def feed_rss(spark, sf_dir):
    date = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>t</title><link>"), "url", F.lit("</link><pubDate>"), date, F.lit(" +0000</pubDate></item><!-- <item> -->"))
    bodies = _feed(spark, sf_dir, item, "<rss><channel><title>f</title>", "", "</channel></rss>")
    return _shown(feeds.rss(bodies, F.lit(CUT).cast("timestamp")))


@query(_feed_sql(f"SELECT * FROM u WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ts DESC, ord) <= 30", "category"))
def feed_sitemap(spark, sf_dir):
    loc = F.concat(F.lit("<loc>"), "url", F.lit("</loc>"))
    news = F.concat(F.lit("<n:news><n:publication_date>"), iso("ts"), F.lit("Z</n:publication_date><n:title><![CDATA[<a:t>]]></n:title></n:news>"))
    item = F.concat(F.lit("<url>"), loc, news, F.lit("</url><url>"), loc, F.lit("<n:news><n:title>no date</n:title></n:news></url>"))
    bodies = _feed(spark, sf_dir, item, "<urlset>", "", "</urlset>")
    return _shown(feeds.sitemap(bodies, F.lit(CUT).cast("timestamp")))


@query(over_articles(_BODIES + " SELECT feed AS source, 'parse: not well-formed' AS error FROM u GROUP BY feed HAVING min(ord) % 100 = 0"))
def feed_malformed(spark, sf_dir):
    item = F.concat(F.lit("<item><title>t</title>"), F.when(F.col("ord") % 100 == 0, "").otherwise("</item>"))
    return feeds.malformed(_feed(spark, sf_dir, item, "<rss><channel>", "", "</channel></rss>"))


@query(_feed_sql(f"SELECT * FROM (SELECT * FROM u QUALIFY {_FIRST}) WHERE ts >= TIMESTAMP '{CUT}' AND ord % 3 <> 0"))
def feed_paged_json(spark, sf_dir):
    kind = F.when(F.col("ord") % 3 == 0, "2").otherwise("1")
    time = F.unix_timestamp(_ts()).cast("string")
    item = F.concat(F.lit('{"type": '), kind, F.lit(', "data": {"title": "t", "publishUrl": "'), "url", F.lit('", "publishTime": '), time, F.lit("}}"))
    return _shown(feeds.paged_json(_feed(spark, sf_dir, item, '{"items": [', ", ", "]}"), F.lit(CUT).cast("timestamp")))


@query(over_articles(_BODIES.replace("'/' || id", "'/player?newsId=' || id") + f""", kept AS (SELECT * FROM u WHERE ts >= TIMESTAMP '{CUT}' AND ord % 3 <> 0 QUALIFY {_FIRST}) """ + _SHOWN.format(iso=ISO, category="category", rows="kept")))
def feed_flat_json(spark, sf_dir):
    title = F.when(F.col("ord") % 3 == 0, " ").otherwise("t")
    time = F.unix_millis(_ts()).cast("string")
    item = F.concat(F.lit('{"newsId": "'), "id", F.lit('", "title": "'), title, F.lit('", "category": "'), "category", F.lit('", "publishDate": '), time, F.lit("}"))
    bodies = _feed(spark, sf_dir, item, "[", ", ", "]")
    return _shown(feeds.flat_json(bodies, F.lit(CUT).cast("timestamp"), "https://h", {c: c for c in ("en", "de", "fr", "es")}))


_STAMPED = "'https://h/' || strftime(ts, '%Y%m%d') || '/bkn-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || id || '.html'"


@query(over_articles(f""", u AS (SELECT *, 'feed' || (ord // 50) AS feed, {_STAMPED} AS url FROM a),
kept AS (SELECT * FROM u WHERE ts - INTERVAL 8 HOUR >= TIMESTAMP '{CUT}' QUALIFY {_FIRST})
SELECT substr(md5(url), 1, 12) AS id, url, strftime(ts - INTERVAL 8 HOUR, {ISO}) AS date, feed AS source FROM kept"""))
def feed_index_page(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("/bkn-"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-"), "id")
    link = F.concat(F.lit('<a href="/'), stamp, F.lit('.html">t</a>'))
    bodies = _feed(spark, sf_dir, F.concat(link, F.lit('<a href="/about">no</a>'), link), "", "", "")
    return _shown(feeds.index_page(bodies, F.lit(CUT).cast("timestamp"), "https://h", r"/bkn-")).select("id", "url", "date", "source")


@query(over_articles(""", u AS (SELECT ord, 'https://h/article/' || (ord // 3) || CASE ord % 3 WHEN 0 THEN '/' WHEN 1 THEN '/' || topic ELSE '/x' END AS url FROM a)
SELECT (ord // 3)::VARCHAR AS number, arg_max(url, (length(url), -ord)) AS url, min(ord) AS ord FROM u GROUP BY ord // 3"""))
def longest_article_urls(spark, sf_dir):
    tail = F.when(F.col("ord") % 3 == 0, "/").when(F.col("ord") % 3 == 1, F.concat(F.lit("/"), "topic")).otherwise("/x")
    urls = articles(spark, sf_dir).select("ord", F.concat(F.lit("https://h/article/"), F.floor(F.col("ord") / 3).cast("string"), tail).alias("url"))
    return feeds.longest_urls(urls, r"/article/(\d+)")


# Dates


@query(over_articles(f" SELECT id, strftime(CASE ord % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 8 HOUR WHEN 2 THEN ts END, {ISO}) AS date FROM a"))
def feed_dates(spark, sf_dir):
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    told = F.when(F.col("ord") % 4 == 0, mail).when(F.col("ord") % 4 == 1, F.concat(mail, F.lit(" +0800"))).when(F.col("ord") % 4 == 2, F.concat(iso("ts"), F.lit("Z"))).otherwise("some day")
    return articles(spark, sf_dir).select("id", F.date_format(dates.feed_date(told), "yyyy-MM-dd'T'HH:mm:ss").alias("date"))


@query(over_articles(" SELECT id, CASE WHEN ord % 3 <> 2 THEN strftime(ts, '%Y-%m-%d') END AS date FROM a"))
def strict_dates(spark, sf_dir):
    told = F.when(F.col("ord") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("ord") % 3 == 1, F.date_format("ts", "yyyy-M-d")).otherwise(F.date_format("ts", "yyyy/MM/dd"))
    return articles(spark, sf_dir).select("id", F.date_format(dates.strict_date(told), "yyyy-MM-dd").alias("date"))


@query(f"""WITH {EVENTS}, s AS (SELECT id, greatest(0, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT) AS s FROM e)
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN (s + 30) // 60 < 60 THEN ((s + 30) // 60)::VARCHAR || ' min'
  WHEN (s + 1800) // 3600 < 48 THEN ((s + 1800) // 3600)::VARCHAR || ' h' ELSE ((s + 43200) // 86400)::VARCHAR || ' d' END AS age FROM s""")
def relative_times(spark, sf_dir):
    return events(spark, sf_dir).select("id", dates.relative(F.date_trunc("SECOND", "ts"), at(NOW)).alias("age"))


@query(over_articles(" SELECT id, row_number() OVER (ORDER BY ts DESC, ord) AS position FROM a"))
def newest_first(spark, sf_dir):
    return rank.numbered(articles(spark, sf_dir).select("id", "ts", "ord"), [F.col("ts").desc(), F.col("ord").asc()]).select("id", "position")


# Text


@query(over_articles(" SELECT id, source = 'src1' OR starts_with(source, 'src2') OR contains(lower(title), 'the') AS own FROM a"))
def site_classes(spark, sf_dir):
    a = articles(spark, sf_dir)
    own = text.is_site(F.col("title"), "the", F.col("source"), "src2") | (F.col("source") == "src1")
    return a.select("id", own.alias("own"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(replace(coalesce(text, ''), '. ', '。 '), '! ', '！ '), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN length(t) < 140 AND len(regexp_extract_all(t, '[。！？；]')) < 2 THEN 1 ELSE len(list_filter(regexp_split_to_array(regexp_replace(t, '([。！？；])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) END AS n FROM t""")
def paragraph_split(spark, sf_dir):
    marked = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("。 ")), F.lit("! "), F.lit("！ "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.split_paragraphs(marked)).cast("long").alias("n"))


@query("SELECT page_id, 'https://m.h' || regexp_replace(url, '^https?://[^/?#]*', '') AS swapped, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/x/1' AS joined FROM pages")
def url_join_swap(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.swapped_host(u, "https://m.h").alias("swapped"), text.joined_url(u, F.lit("/x/1")).alias("joined"))


# Blocks


@query(over_articles(" SELECT id, CASE WHEN score >= 9 AND ord % 2 = 0 THEN 'breaking' WHEN score >= 8 THEN 'important' WHEN ord % 3 = 0 THEN topic ELSE '' END AS reason FROM a"))
def alert_reasons(spark, sf_dir):
    flags = F.when(F.col("ord") % 3 == 0, F.array("topic")).otherwise(F.array().cast("array<string>"))
    return articles(spark, sf_dir).select("id", dashboard.alert_reason((F.col("score") >= 9) & (F.col("ord") % 2 == 0), F.col("score"), flags).alias("reason"))


@query(over_articles(" SELECT id, array_to_string(list_filter(['type:' || topic, 'people:' || source, 'people:' || category, 'places:' || sentiment], lambda x: x <> 'type:'), '|') AS facts FROM a"))
def article_facts(spark, sf_dir):
    none = F.array().cast("array<string>")
    entities = F.struct(F.array("source", "category").alias("people"), none.alias("companies"), F.array("sentiment").alias("places"), none.alias("dates"), none.alias("numbers"))
    facts = articles(spark, sf_dir).select("id", dashboard.facts(F.col("topic"), entities).alias("f"))
    return facts.select("id", F.array_join(F.transform("f", lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), "|").alias("facts"))


@query(over_articles(f" SELECT id FROM a WHERE source NOT IN ('src3', 'src4') AND ord % 7 <> 3 AND (epoch(TIMESTAMP '{NOW}') - epoch(ts))::BIGINT / 3600.0::DOUBLE <= 240"))
def ai_pool(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("duplicate_of", F.when(F.col("ord") % 7 == 3, F.lit("x")))
    return dashboard.pool(rows, spark.createDataFrame([("src3",), ("src4",)], "source string"), at(NOW), 240).select("id")


_DIGESTS = ", d AS (SELECT DISTINCT cluster_id, length(topic) % 4 AS timeline, length(topic) % 3 AS contradictions FROM c WHERE cluster_id IS NOT NULL), k AS (SELECT DISTINCT cluster_id FROM c WHERE cluster_id IS NOT NULL AND score >= 10)"


@query(over_articles(_CLUSTERED + _DIGESTS + " SELECT id, c.cluster_id IS NOT NULL AS stack, k.cluster_id IS NOT NULL AS breaking, coalesce(timeline >= 2, false) AS timeline, coalesce(contradictions > 0, false) AS contradiction FROM c LEFT JOIN d ON d.cluster_id = c.cluster_id LEFT JOIN k ON k.cluster_id = c.cluster_id"))
def card_indicators(spark, sf_dir):
    c = clustered(spark, sf_dir)
    own = c.filter("cluster_id IS NOT NULL")
    some = lambda n: F.slice(F.array(*[F.lit("x")] * 3), F.lit(1), n)
    digests = own.select("cluster_id", "topic").distinct().select("cluster_id", F.struct(some(F.length("topic") % 4).alias("timeline"), some(F.length("topic") % 3).alias("contradictions")).alias("digest"))
    return dashboard.card_indicators(c, digests, own.filter("score >= 10"))


@query(over_articles(_CLUSTERED + ", t AS (SELECT min(cluster_id) AS cid FROM c) SELECT id, cluster_size FROM c, t WHERE cluster_id = cid"))
def cluster_expansion(spark, sf_dir):
    c = clustered(spark, sf_dir)
    return dashboard.expand(c, c.agg(F.min("cluster_id")).first()[0] or "").select("id", "cluster_size")


@query(f"WITH {EVENTS}, h AS (SELECT id, (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)))::BIGINT / 3600.0::DOUBLE AS h FROM e) SELECT id, CASE WHEN h < 1 THEN 2.0 WHEN h < 3 THEN 1.0 WHEN h < 6 THEN 0.5 ELSE 0.0 END::DOUBLE AS step FROM h")
def recency_steps(spark, sf_dir):
    return events(spark, sf_dir).select("id", dashboard.recency_step(F.date_trunc("SECOND", "ts"), at(NOW)).alias("step"))


@query(over_articles(" SELECT id FROM a WHERE score >= 5 OR ord % 4 = 0"))
def hot_rows(spark, sf_dir):
    return dashboard.hot_list(articles(spark, sf_dir).withColumn("is_breaking", F.col("ord") % 4 == 0)).select("id")


@query(over_articles(" SELECT id FROM a WHERE score >= 7"))
def hot_tab(spark, sf_dir):
    return dashboard.preset(articles(spark, sf_dir), "hot").select("id")


@query(over_articles(" SELECT id, row_number() OVER (ORDER BY ord) AS position FROM a"))
def navigation_order(spark, sf_dir):
    a = articles(spark, sf_dir)
    session = a.filter("ord % 2 = 0").select("id", F.col("ord").alias("position"))
    return dashboard.navigation(a, session, "not in it")


@query(over_articles(" SELECT id, md5('### 第 ' || (1 + ord % 9)::VARCHAR || ' 篇' || chr(10) || '來源：' || coalesce(trim(source), '') || '（' || strftime(ts, '%Y-%m-%d') || '）' || chr(10) || '標題：' || trim(topic) || chr(10) || '摘要：' || trim(replace(title, chr(10), ' '))) AS digest FROM a"))
def digest_prompts(spark, sf_dir):
    row = dashboard.digest_member(1 + F.col("ord") % 9, F.col("source"), F.col("ts"), F.col("topic"), F.col("title"))
    return articles(spark, sf_dir).select("id", F.md5(row.cast("binary")).alias("digest"))


@query(over_articles(" SELECT id AS article_id, title AS body, 'https://h/article.html?id=' || id AS url FROM a WHERE score >= 9"))
def alert_messages(spark, sf_dir):
    return dashboard.alert_messages(articles(spark, sf_dir).filter("score >= 9").select(F.col("id").alias("article_id"), F.col("title").alias("headline")), "https://h/")


# State and vectors


@query(over_articles(" SELECT id, CASE WHEN ord % 3 = 0 THEN 3 WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS quality, CASE WHEN ord % 3 = 0 THEN 'current' WHEN ord % 2 = 0 THEN 'previous' ELSE 'computed' END AS origin FROM a"))
def quality_upsert(spark, sf_dir):
    a = articles(spark, sf_dir)
    return state.upsert_quality(a.select("id", F.when(F.col("ord") % 3 == 0, 3).alias("quality")), a.filter("ord % 2 = 0").select("id", F.lit(2).alias("quality")), a.select("id", F.lit(1).alias("quality")))


@query("SELECT 'm' AS model, max(len(embedding))::INT AS dim, count(*) AS count FROM embeddings")
def vector_meta(spark, sf_dir):
    return sinks.vector_meta(table(spark, sf_dir, "embeddings"), "m")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.e, b.e) / a.l / b.l AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS nth FROM p WHERE s >= 0.45)
SELECT vec_id AS id, string_agg(other::VARCHAR, ',' ORDER BY nth) AS similar FROM r WHERE nth <= 5 GROUP BY 1""")
def similar_rows(spark, sf_dir):
    rows = sinks.similar_rows(vectors.cosine_top_k(table(spark, sf_dir, "embeddings")))
    return rows.select("id", F.array_join(F.transform("similar", lambda x: x.cast("string")), ",").alias("similar"))


# Streams


@query("""WITH RECURSIVE e AS (SELECT event_type AS topic, ts FROM events), r AS (
  SELECT topic, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT r.topic, (SELECT min(e.ts) FROM e WHERE e.topic = r.topic AND e.ts > r.ts + INTERVAL 48 HOUR) FROM r WHERE r.ts IS NOT NULL)
SELECT topic, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM r WHERE ts IS NOT NULL""")
def stream_alert_once(spark, sf_dir):
    from loomwire.streaming.jobs import alert_once

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drained(alert_once(_replay(spark, sf_dir)), "append").select("topic", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


_PHRASES = {"the": "T", "th": "t!", "an": "", "n": "N", "ation": "<ation>", "é": "e", "en er": "ENER"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PHRASES.items())


@query(over_articles(f" SELECT id, array_to_string(list_transform(regexp_extract_all(title, '{'|'.join(sorted(_PHRASES, key=lambda k: (-len(k), k)))}|(?s:.)'), lambda x: CASE x {_CASES} ELSE x END), '') AS title FROM a"))
def phrase_conversion(spark, sf_dir):
    return articles(spark, sf_dir).select("id", feeds.converted(F.col("title"), _PHRASES).alias("title"))


# Sitemap trees: fifty articles in a row are the pages of one tree, of which forty are read in batches of ten


@query(over_articles(""", p AS (SELECT 'feed' || (ord // 50) AS source, 'https://h/' || id AS url, row_number() OVER (PARTITION BY ord // 50 ORDER BY ord) - 1 AS pos FROM a)
SELECT source, pos::INT AS pos, url, (pos // 10)::INT AS batch FROM p WHERE pos < 40"""))
def sitemap_walk(spark, sf_dir):
    page = F.concat(F.lit("<url><loc>https://h/"), "id", F.lit("</loc></url>"))
    leaves = _feed(spark, sf_dir, page, "<urlset>", "", "</urlset>")
    leaf = leaves.select(F.concat(F.lit("https://h/leaf/"), "source").alias("url"), "body")
    child = lambda url: F.concat(F.lit("<s:sitemap><s:loc> "), url, F.lit(" </s:loc></s:sitemap>"))

    def index(name: str, below: str) -> DataFrame:
        there = F.concat(F.lit(f"https://h/{below}/"), "source")
        body = F.concat(F.lit("<s:sitemapindex>"), child(F.lit("https://h/none")), child(there), F.lit("</s:sitemapindex>"))
        return leaves.select(F.concat(F.lit(f"https://h/{name}/"), "source").alias("url"), body.alias("body"))

    bodies = leaf.unionByName(index("middle", "leaf")).unionByName(index("root", "middle"))
    roots = leaves.select("source", F.concat(F.lit("https://h/root/"), "source").alias("url"))
    return feeds.page_batches(feeds.walk_sitemaps(roots, bodies, most=40)).select("source", "pos", "url", "batch")
