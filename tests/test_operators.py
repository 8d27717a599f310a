"""Small cases worked out by hand for operators, functions, sources, sinks and streams."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomwire.functions import answers, dates, html, text
from loomwire.operators import clusters, components, dedup, facets, graph, rank, search, state, trends, vectors
from loomwire.sources import feeds, sinks
from loomwire.streaming import jobs

NOW = dt.datetime(2026, 4, 21, 12)


def at(hours: float) -> dt.datetime:
    return NOW - dt.timedelta(hours=hours)


def now():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_freshness_bounds_differ_at_the_limit(spark):
    rows = spark.createDataFrame([("a", at(29)), ("b", at(30)), ("c", at(31)), ("d", None)], "id string, ts timestamp")
    assert {r.id for r in trends.fresh(rows, now()).collect()} == {"a", "b"}
    assert {r.id for r in trends.fresh(rows, now(), strict=True).collect()} == {"a"}


def test_trending_counts_only_the_window(spark):
    rows = spark.createDataFrame([("t1", "x", "s1", 6, at(1)), ("t2", "x", "s2", 8, at(2)), ("t3", "x", "s2", 8, at(5)), ("t4", "y", "s1", 5, at(1))], "id string, topic string, source string, score int, ts timestamp")
    got = trends.trending(rows, now()).collect()
    assert [(r.topic, r.n, r.n_sources, r.avg_score) for r in got] == [("x", 2, 2, 7.0)]
    assert got[0].heat == 8 * 2 + 5 * 2 + 3 * 7 + 2 * 3


def test_breaking_needs_three_sources_and_headlines_from_all(spark):
    rows = spark.createDataFrame([("a", "c", "s1", 5, at(1), 0), ("b", "c", "s2", 6, at(1), 1), ("d", "c", "s3", 4, at(1.5), 2), ("e", "c", "s4", 9, at(9), 3), ("f", "k", "s1", 9, at(1), 4)], "id string, cluster_id string, source string, score int, ts timestamp, ord int")
    got = trends.breaking(rows, now()).collect()
    assert [(r.cluster_id, r.headline, r.sources) for r in got] == [("c", "e", "s1,s2,s3")]


def test_near_duplicates_keep_the_best(spark):
    rows = spark.createDataFrame(
        [(0, "a", "Government announces new budget plan", 5, NOW), (1, "b", "Government announces: new budget plan!", 8, NOW), (2, "c", "Rain expected in the north", 9, NOW), (3, "d", None, 1, NOW), (4, "e", "", 1, NOW)],
        "ord int, id string, title string, score int, ts timestamp",
    )
    got = {r.id: (r.duplicate_of, r.duplicate_count) for r in dedup.mark_duplicates(rows).collect()}
    assert got == {"a": ("b", None), "b": (None, 2), "c": (None, None), "d": (None, None), "e": (None, None)}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "x long, y long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_clusters_topics_and_signatures(spark):
    rows = spark.createDataFrame([("1", " x ", "s1", 5), ("2", "x", "s2", 9), ("3", "y", "s1", 9), ("4", "", "s1", 9), ("5", None, "s1", 9)], "id string, topic string, source string, score int").withColumn("topic", clusters.canonical_topic(F.col("topic"), ()))
    got = clusters.with_clusters(rows)
    assert {r.id for r in got.filter("cluster_id IS NOT NULL").collect()} == {"1", "2"}
    a, b = (clusters.signatures(got.orderBy(o)).first().signature for o in ("id", F.desc("id")))
    assert a == b and len(a) == 12
    assert clusters.signatures(got.filter("id <> '2'")).first().signature != a


@pytest.mark.parametrize(("size", "peak", "in_"), [(4, 5, True), (2, 9, True), (2, 6, False), (1, 10, False)])
def test_qualifying_clusters(spark, size, peak, in_):
    rows = spark.createDataFrame([("c", peak)] * size, "cluster_id string, score int")
    assert (clusters.qualifying(rows).count() == 1) is in_


def test_flags_are_three_at_most_in_order(spark):
    plain = ("Plain", "text", 9)
    rows = [("a", "據報有變", "", 9, "s1", None, 10, None, "可能"), ("b", *plain, "s1", "c", 900, None, None), ("d", *plain, "s2", "c", 900, None, None), ("e", *plain, "s1", "k", 600, None, None), ("f", *plain, "s2", "k", 600, "e", None), ("g", "t", None, 5, "s", None, 499, None, None)]
    got = {r.id: r.flags for r in clusters.uncertainty_flags(spark.createDataFrame(rows, "id string, title string, summary string, score int, source string, cluster_id string, chars int, duplicate_of string, event_type string")).collect()}
    assert got == {"a": ["消息未證實", "仍有變數", "全文不足"], "b": [], "d": [], "e": ["單一來源"], "f": ["單一來源"], "g": ["全文不足", "AI摘要缺失"]}


def test_near_copies_are_no_reports(spark):
    rows = [("1", "x", "s1", 5, at(1), 0, None), ("2", "x", "s2", 9, at(1), 1, None), ("3", "x", "s3", 9, at(1), 2, "1"), ("4", "y", "s1", 9, at(1), 3, None), ("5", "y", "s2", 9, at(1), 4, "4")]
    df = spark.createDataFrame(rows, "id string, topic string, source string, score int, ts timestamp, ord int, duplicate_of string")
    got = {r.id: r.cluster_size for r in clusters.with_clusters(df).collect()}
    assert got == {"1": 2, "2": 2, "3": None, "4": None, "5": None}
    assert [(r.topic, r.n, r.n_sources) for r in clusters.clusters(df).collect()] == [("x", 2, 2)]
    assert trends.breaking(df.withColumn("cluster_id", F.col("topic")), now()).count() == 0
    alerts = trends.alert_candidates(df.withColumns({"cluster_id": F.lit(None).cast("string"), "is_breaking": F.lit(False), "flagged": F.lit(False)}), now(), spark.createDataFrame([("s1",)], "source string"))
    assert [r.id for r in alerts.collect()] == ["2"]


def test_graph_counts_mentions_and_pairs(spark):
    rows = spark.createDataFrame([(1, "p", "Ann"), (1, "p", "Ann"), (1, "c", "Acme"), (2, "p", "Ann"), (2, "c", "Acme"), (2, "c", "X"), (3, "p", "Bob")], "article int, type string, label string")
    nodes = graph.nodes(rows)
    assert {(r.label, r.mentions, r.articles) for r in nodes.collect()} == {("Ann", 3, 2), ("Acme", 2, 2)}
    assert [tuple(r) for r in graph.edges(rows, nodes).collect()] == [("c:Acme", "p:Ann", 2, "1,2")]


def test_calendar_merges_and_bounds(spark):
    d = lambda n: (NOW + dt.timedelta(days=n)).date()
    rows = spark.createDataFrame([(d(5), "Big Match", "a", 1), (d(5), "big  match", "b", 2), (d(-1), "Past", "c", 3), (d(91), "Far", "d", 4), (d(90), "Edge", "e", 5), (None, "None", "f", 6)], "date date, title string, article string, ord int")
    got = [(r.title, r.n, r.articles) for r in graph.calendar(rows, F.lit(NOW.date())).collect()]
    assert got == [("Big Match", 2, "a,b"), ("Edge", 1, "e")]


def test_search_language(spark):
    q = search.parse("source:A Tag:b score>=7 score<9 free words source:C")
    assert q == search.Query({"source": "c", "tag": "b"}, ("<", 9), "free words")
    rows = spark.createDataFrame([("1", "One free thing", "cnn", "w", "t", 8, ["bb"], ["thin"]), ("2", "two", "cnn", "w", "t", 8, [], [])], "id string, title string, source string, category string, topic string, score int, tags array<string>, flags array<string>")
    ids = lambda s: [r.id for r in search.search(rows, s).orderBy("id").collect()]
    assert ids("source:c tag:b") == ["1"] and ids("risk:uncertain") == ["1"] and ids("score>8") == [] and ids("free") == ["1"] and ids("") == ["1", "2"] and ids("score=8") == []


def test_related_needs_a_shared_key(spark):
    schema = "id string, ts timestamp, cluster_id string, topic string, event_type string, people array<string>, companies array<string>, places array<string>, dates array<string>, numbers array<string>"
    rows = spark.createDataFrame([("q", NOW, "c", "t", "e", ["Ann"], None, ["HK"], None, None), ("same", NOW, "c", "t", "e", ["Ann"], [], ["HK"], None, None), ("topic", NOW, None, "t", "", None, None, None, None, None), ("place", NOW, None, "z", "e", None, None, ["HK"], None, None)], schema)
    got = {r.other: r.score for r in rank.related(rows.filter("id = 'q'"), rows, now()).collect()}
    assert got == {"same": 100 + 35 + 22 + 4 + 3 + 8, "topic": 35 + 8}


def test_importance_beats_freshness(spark):
    rows = spark.createDataFrame([("old", 9, 1, at(40)), ("new", 5, 1, at(0)), ("big", 5, 9, at(0))], "id string, score int, cluster_size int, ts timestamp")
    got = {r.id: r.r for r in rows.select("id", rank.importance(now()).alias("r")).collect()}
    assert got["old"] > got["new"] and got["big"] == got["new"] + 12


def test_neighbours_wrap(spark):
    rows = spark.createDataFrame([("g", i, i in (0, 3)) for i in range(4)], "g string, n int, unread boolean")
    got = [(r.previous, r.next, r.next_unread) for r in rank.neighbours(rows, "g", "n", "n", "unread").orderBy("n").collect()]
    assert got == [(None, 1, 3), (0, 2, 3), (1, 3, 3), (2, None, 0)]


def test_cosine_blocks_agree_with_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {i: [j for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.45] for i in range(60)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    for block in (1000, 16):
        got: dict = {i: [] for i in range(60)}
        for r in vectors.cosine_top_k(df, block=block).orderBy("vec_id", "nth").collect():
            got[r.vec_id].append(r.other)
        assert got == want


def test_state_operators(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, source string, summary string, content string, title string, url string")
    new, old = rows(("a", "s1", "", "x", "t", "u"), ("b", "s1", "ok", None, "t", "u")), rows(("a", "s1", "past", "x", "t", "u"), ("c", "s2", None, "z", "t", "u"), ("b", "s1", "x", "y", "t", "u"))
    assert {(r.id, r.restored) for r in state.restore_missing(new, old).collect()} == {("a", False), ("b", False), ("c", True)}
    assert {(r.id, r.summary) for r in state.fall_back(new, old, ["content"]).collect()} == {("a", "past"), ("b", "ok")}
    assert {(r.id, r.action, r.content) for r in state.upsert_content(new.unionByName(rows(("n", "s", "", "", "t", "u"))), old).collect()} == {("a", "unchanged", "x"), ("b", "reused", "y"), ("n", "minimal", "t\nu")}
    assert [r.id for r in state.new_ids(old, new).collect()] == ["c"]
    assert {r.id for r in state.toggle(new, old).collect()} == {"c"}


def test_facets(spark):
    rows = spark.createDataFrame([("w", "positive"), ("w", "negative"), ("w", "neutral")], "category string, sentiment string")
    r = facets.sentiment_by(rows).first()
    assert (r.positive_pct, r.negative_pct, r.neutral_pct) == (33, 33, 34)
    stats = spark.createDataFrame([("a", 0, 0, "x"), ("b", 0, 0, None), ("c", 0, 2, None), ("d", 1, 0, None)], "source string, n int, restored int, error string")
    assert [r.health for r in facets.source_health(stats).orderBy("rank").collect()] == ["error", "empty", "cached", "ok"]


def test_text_functions(spark):
    c = F.lit
    r = one(
        spark,
        text.bigrams(c("A-b c")).alias("g"), text.bigrams(c("a")).alias("short"), text.clean_url(c('http://x/a"b')).alias("u"), text.bullets(c("・one・two")).alias("b"), text.bullets(c("a・b")).alias("plain"),
        text.string_list(c("#a, b，a\nlonger than the width of it all"), 3, 8).alias("l"), text.key_sentences(F.array(c("“Quoted sentence here”"), c("short"), c("Quoted sentence here"))).alias("k"), text.sentences(c("一3.5。 Two!！ Three")).alias("s"), text.escape_xml(c("<a & 'b'>")).alias("x"),
        text.json_object(c('```json\n{"a": 1}\n```')).alias("j"), text.has_cjk(c("新聞")).alias("cjk"), text.first_category(c("http://x/%E4%B8%AD/1"), (("/中/", "cn"),), "no").alias("cat"), text.read_minutes(c(0)).alias("m0"), text.read_minutes(c(760)).alias("m"),
    )
    assert r.g == ["ab", "bc"] and r.short == [] and r.u == "http://x/a" and r.b == "・one\n・two" and r.plain == "a・b"
    assert r.l == ["a", "b", "longer t"] and r.k == ["Quoted sentence here"] and r.s == ["一3.5。", "Two!！", "Three"] and r.x == "&lt;a &amp; &apos;b&apos;&gt;"
    assert json.loads(r.j) == {"a": 1} and r.cjk and r.cat == "cn" and r.m0 == 0 and r.m == 2


def test_feed_dates(spark):
    cases = {"Tue, 21 Apr 2026 10:00:00": 10, "Tue, 21 Apr 2026 10:00:00 +0800": 2, "2026-04-21T10:00:00Z": 10, "2026-04-21T10:00:00+08:00": 2, "Tue, 21 Apr 2026 10:00:00 GMT": 10, "nonsense": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", F.hour(dates.feed_date(F.col("d"))).alias("h"))
    assert {r.d: r.h for r in rows.collect()} == cases
    r = one(spark, dates.strict_date(F.lit("2026-5-2")).alias("a"), dates.strict_date(F.lit("2026/05/02")).alias("b"), dates.stamp_in_url(F.lit("/x/20260421/bkn-20260421100000-1.htm")).alias("c"), dates.stamp_in_url(F.lit("/x/20260421100000-1.htm")).alias("d"))
    assert str(r.a) == "2026-05-02" and r.b is None and r.c.hour == 2 and r.d is None


def test_answers_are_read_tolerantly(spark):
    raw = '```json\n{"summary": ["one", "・two"], "score": "15", "sentiment": "ANGRY", "tags": "#a, b", "topic": "' + "t" * 30 + '", "entities": {"people": "Ann, Bob, Cy", "numbers": 7}, "upcoming_events": [{"date": "2026-05-02", "title": "x"}, {"date": "2026/05/02", "title": "y"}]}\n```'
    a = one(spark, answers.analysis(F.lit(raw)).alias("a"), answers.analysis(F.lit("no")).alias("b"))
    assert a.b is None
    assert a.a.summary == "・one\n・two" and a.a.score == 10 and a.a.sentiment == "neutral" and a.a.tags == ["a", "b"] and len(a.a.topic) == 20
    assert a.a.entities.people == ["Ann", "Bob"] and [e.date for e in a.a.upcoming_events] == ["2026-05-02"]
    good = {"headline": "h", "angles": [{"label": f"l{i}", "sources": ["s"], "summary": ""} for i in range(6)], "contradictions": [{"topic": "t"}]}
    d = one(spark, answers.digest(F.lit(json.dumps(good))).alias("d"), answers.digest(F.lit(json.dumps(good | {"angles": good["angles"][:1]}))).alias("e"))
    assert len(d.d.angles) == 4 and d.d.contradictions == [] and d.e is None
    df = spark.createDataFrame([(1, '[{"a": 1}, 5]', 2), (2, "[{}]", 2)], "k int, raw string, n int")
    assert sorted(map(tuple, answers.slots(df, "raw", "n", "k").collect())) == [(1, 0, '{"a":1}'), (1, 1, None), (2, 0, None), (2, 1, None)]


def test_html(spark):
    page = '<html><head><title> T </title><script>x("<p>no</p>")</script></head><body><nav>menu</nav><article><p>First</p><img data-src="/a.jpg"><p>Second &amp; last</p></article></body></html>'
    r = one(spark, html.title(F.lit(page)).alias("t"), html.article_flow(F.lit(page), F.lit("http://h/x")).alias("f"), html.blocked(F.lit("<b>Please enable cookies</b>")).alias("b"), html.sanitise(F.lit('<p onclick="x()">a<script>b</script><a href=" javascript:x">c</a><img src="data:image/png;1"></p>')).alias("s"), html.highlight(F.lit("say  hello   world now"), F.lit("hello world")).alias("h"))
    assert r.t == "T" and r.b and [(x.kind, x.value) for x in r.f] == [("text", "First"), ("image", "http://h/a.jpg"), ("text", "Second & last")]
    assert r.s == '<p>a<a>c</a><img src="data:image/png;1"></p>' and r.h == "say  <mark>hello   world</mark> now"
    noscript = html.rewritten('<noscript><img src="/n.png"></noscript><picture><source srcset="z"><img src="http://h/p.png"></picture><img>', "http://h")
    assert noscript == '<img src="http://h/n.png"><img src="http://h/p.png">'
    assert html.embedded('<script id="__NEXT_DATA__">{"props":{"pageProps":{"article":{"blocks":[{"text":"a"},{"image":"http://i"}]}}}}</script>') == [{"text": "a"}, {"image": "http://i"}]
    f = one(spark, html.feed_fallback(F.lit("T"), F.lit("一。 二！三；"), F.lit("http://i"), F.lit("u")).alias("a"), html.feed_fallback(F.lit("T"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("u")).alias("b"))
    assert f.a.count("<p>") == 3 and "<img" in f.a and 'href="u"' in f.b


def test_last_touches_of_articles(spark):
    assert html.without_relative_images('<p>a<img src="/x.jpg"><img alt="" src="https://h/y.jpg"><img src="data:image/png;1"></p>') == '<p>a<img alt="" src="https://h/y.jpg"><img src="data:image/png;1"></p>'
    assert html.without_leading_title("<h1>Big  <b>News</b></h1><p>x</p>", "Big News today") == "<p>x</p>" and html.without_leading_title("<h1>Other</h1>", "Big") == "<h1>Other</h1>"
    assert html.with_featured_image("<html><body><p>x</p></body></html>", "http://i?a&b") == '<html><body><img src="http://i?a&amp;b"><p>x</p></body></html>' and html.with_featured_image("<img>", "http://i") == "<img>"
    assert html.with_intro("<h2>Part one</h2><p>text</p>", "The lead. Part one and more") == "<p>The lead.</p><h2>Part one</h2><p>text</p>"
    assert html.with_intro("<p>The lead.</p><h2>Part one</h2>", "The lead. Part one") == "<p>The lead.</p><h2>Part one</h2>" and html.with_intro("<p>x</p>", None) == "<p>x</p>"
    page = '<script>const article_galleries = {"gallery-1": [{"src": "http://a", "caption": "c"}, {"alt_text": "none"}]};\n</script><gallery-1></gallery-1><GALLERY-1/><gallery-2>'
    assert html.with_galleries(page).count('<img src="http://a" alt="c">') == 2 and html.with_galleries("<gallery-1>") == "<gallery-1>"
    page = '<div class="x prefixHidden">http://h/p/</div><div class="article-details-content-container"><p>One</p><p>{{cms:inline-image name="a.jpg"}}</p><p>Two {{cms:inline-image name="b.jpg"}}</p><img src="http://c"></div>'
    assert html.placeholder_flow(page) == [{"text": "One"}, {"image": "http://h/p/a.jpg"}, {"text": "Two"}, {"image": "http://h/p/b.jpg"}, {"image": "http://c"}]
    r = one(spark, html.finished(F.lit("<h1>T</h1><p>x</p>"), F.lit("T"), F.lit("http://i"), F.lit(None).cast("string")).alias("c"))
    assert r.c == '<img src="http://i"><p>x</p>'
    assert html.shown(html.tree('<p class="a">x<br>y &amp; z</p>')) == '<p class="a">x<br>y &amp; z</p>'


def test_feeds(spark):
    rss = '<rss><channel><item><title><![CDATA[A & B]]></title><link>http://x/1?a=1&amp;b=2</link><pubDate>Tue, 21 Apr 2026 10:00:00 GMT</pubDate><media:thumbnail url="http://t"/><description>d</description></item><item><title>old</title><link>http://x/2</link><pubDate>Tue, 14 Apr 2026 10:00:00 GMT</pubDate></item><item><title>n</title><link>http://x/3</link></item></channel></rss>'
    site = '<urlset><url><loc>https://h/%E4%B8%AD/1</loc><image:image><image:loc>http://img</image:loc></image:image><n:news><n:publication_date>2026-04-21T11:00:00Z</n:publication_date><n:title>新</n:title></n:news></url></urlset>'
    cut = F.lit("2026-04-20 06:00:00").cast("timestamp")
    body = lambda b: spark.createDataFrame([("s", b)], "source string, body string")
    a = feeds.rss(body(rss), cut)
    assert [(r.title, r.url, r.thumbnail, r.content) for r in a.collect()] == [("A & B", "http://x/1?a=1&b=2", "http://t", "d")]
    b = feeds.sitemap(body(site), cut, cjk=True)
    assert [(r.title, r.category, r.thumbnail) for r in b.collect()] == [("新", "中", "http://img")]
    s = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())
    c = feeds.paged_json(body(json.dumps({"items": [{"type": 1, "data": {"title": "j", "publishUrl": "http://j", "publishTime": s}}, {"type": 2, "data": {"title": "no"}}]})), cut)
    assert [r.title for r in c.collect()] == ["j"]
    d = feeds.flat_json(body(json.dumps([{"newsId": 9, "title": "k", "category": "A", "publishDate": s * 1000, "imageList": [{"imageUrl": "http://p"}]}])), cut, "http://b", {"A": "aa"})
    assert [(r.url, r.category, r.thumbnail) for r in d.collect()] == [("http://b/aa/player?newsId=9", "aa", "http://p")]
    e = feeds.index_page(body('<a href="/news/20260421/bkn-20260421180000-1.htm"><img src="/t.jpg">Title</a><a href="/about">no</a>'), cut, "http://h", r"/bkn-\d{14}")
    assert [(r.title, r.ts.hour, r.thumbnail) for r in e.collect()] == [("Title", 10, "http://h/t.jpg")]
    assert [r.title for r in feeds.union_all([a, b, a]).collect()] == ["新", "A & B"]


def test_landed_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><item/><item/></rss>")
    spark.dataSource.register(feeds.LandedFeeds)
    got = {r.source: (r.items, r.error is None) for r in spark.read.format("landed_feeds").option("feeds", f"a={tmp_path}/a.xml\nb={tmp_path}/none.xml").load().collect()}
    assert got == {"a": (2, True), "b": (0, False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "A & B", "u", "s\nt", NOW, "x", "big")], "id string, title string, url string, summary string, ts timestamp, source string, content string")
    doc = sinks.rss(rows, "Feed", "http://f")
    assert "<title>A &amp; B</title>" in doc and "<description>s t</description>" in doc and "Tue, 21 Apr 2026 12:00:00 +0000" in doc
    sinks.write_json(sinks.light(rows), str(tmp_path / "j"))
    assert "content" not in spark.read.json(str(tmp_path / "j")).columns
    assert sinks.slim(rows).columns == ["id", "title", "url", "ts", "source"]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stream_bursts(spark, tmp_path):
    rows = [("c", f"s{i}", i, NOW + dt.timedelta(minutes=i)) for i in range(3)] + [("d", "s", 1, NOW)]
    got = _run(jobs.bursts(_stream(spark, tmp_path, rows, "topic string, source string, score int, ts timestamp"), slide="2 hours"), "bursts", "update").collect()
    assert [(r.topic, r.n, r.n_sources) for r in got] == [("c", 3, 3)]


def test_stream_alerts_once(spark, tmp_path):
    rows = [("c", at(60), "a"), ("c", at(59), "b"), ("c", at(1), "e"), ("d", at(1), "f")]
    got = _run(jobs.alert_once(_stream(spark, tmp_path, rows, "topic string, ts timestamp, id string")), "alerts").collect()
    assert {r.id for r in got} == {"a", "e", "f"}


def test_stream_each_batch_upserts(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 1)]
    out = str(tmp_path / "out")
    jobs.each_batch(_stream(spark, tmp_path, rows, "id string, n int"), lambda df, k: df.groupBy("id").agg(F.max("n").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={k}"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.id, r.n) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 1)]


def test_rules_at_their_limits(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ages = {0: "just now", 59: "just now", 89: "1 min", 90: "2 min", 3569: "59 min", 3570: "1 h", 105 * 60: "2 h", 30 * 3600: "30 h", 47 * 3600 + 1799: "47 h", 47 * 3600 + 1800: "2 d", 60 * 3600: "3 d", -5: "just now"}
    rows = spark.createDataFrame([(s,) for s in ages], "s long").select("s", dates.relative(F.timestamp_seconds(F.unix_seconds(now) - F.col("s")), now).alias("age"))
    assert {r.s: r.age for r in rows.collect()} == ages
    scores = {'{"score": "7.9"}': 5, '{"score": 7.9}': 7, '{"score": " 8 "}': 8, '{"score": "x"}': 5, '{"score": 99}': 10, '{"score": -3}': 1, '{"score": true}': 1, '{"score": null}': 5, "{}": 5, '{"score": [1]}': 5}
    read = spark.createDataFrame([(j,) for j in scores], "j string").select("j", answers.score(F.try_parse_json("j")).alias("score"))
    assert {r.j: r.score for r in read.collect()} == scores
    topics = spark.createDataFrame([(" a ", "the IPO", None), (" a ", "the ipo", ""), (None, "x", "IPO"), ("IPO", None, None)], "topic string, title string, summary string")
    named = topics.select(clusters.canonical_topic(F.col("topic"), (("market", ("IPO",)),), F.col("title"), F.col("summary")).alias("t"))
    assert [r.t for r in named.collect()] == ["market", "a", "market", "market"]
    mentions = spark.createDataFrame([(i, "p", n, d) for i in range(4) for n, d in (("Ann ", None), ("X", None), ("Bob", "1" if i < 2 else None))], "article int, type string, label string, duplicate_of string")
    assert [(r.label, r.articles) for r in graph.top_entities(mentions).collect()] == [("Ann", 4)]
    dropped = spark.createDataFrame([("x", NOW, True), (None, None, True), (None, NOW, False), (None, NOW, True)], "duplicate_of string, ts timestamp, has_entities boolean")
    assert {tuple(r) for r in graph.drop_reasons(dropped, F.lit(NOW)).collect()} == {("duplicate", 1), ("no date", 1), ("ok", 2), ("no entities", 1)}
    tied = spark.createDataFrame([("c", f"s{i}", 5, NOW, i, f"id{i}") for i in range(7)], "cluster_id string, source string, score int, ts timestamp, ord int, id string")
    found = trends.breaking(tied, F.lit(NOW)).first()
    assert (found.headline, found.n_sources, found.sources) == ("id0", 7, "s0,s1,s2,s3,s4")


def test_breaking_clusters_name_every_source(spark, tmp_path):
    from loomwire.plans import catalogue

    rows = [(i, NOW, i, "c", 1.0, "{}") for i in range(12)] + [(20 + i, NOW, i, "d", 1.0, "{}") for i in range(2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["breaking_clusters"](spark, str(tmp_path)).collect()
    assert [(r.topic, r.n_sources, r.sources) for r in got] == [("c", 12, ",".join(sorted(str(i) for i in range(12))))]


def test_feed_bodies_are_read_as_xml(spark):
    cut = F.lit("2024-01-01 00:00:00").cast("timestamp")
    body = lambda *b: spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(b)], "source string, body string")
    entry = lambda k: f"<item><title>t{k}</title><link>http://h/{k}</link><pubDate>Mon, {k:02d} Jan 2024 00:00:00 GMT</pubDate></item>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html"><![CDATA[<item>]]></title><link rel="self" href="http://h/self"/><link href="http://h/a"/><updated>2024-01-02T00:00:00Z</updated></entry><entry/></feed>'
    many = "<rss><channel><!-- " + entry(1) + " -->" + "".join(entry(k) for k in range(1, 29)) + "</channel></rss>"
    files = body(many, atom, "<rss><channel>" + entry(1), None, "")
    assert sorted((r.source, r.url) for r in feeds.rss(files, cut, max_items=2).collect()) == [("s0", "http://h/1"), ("s0", "http://h/2"), ("s1", "http://h/a")]
    assert {r.source for r in feeds.malformed(files).collect()} == {"s2", "s3", "s4"}
    url = lambda p, k, d: f"<{p}url><{p}loc>http://h/x/{k}</{p}loc><n:news><n:title>t</n:title><n:publication_date>2024-01-{d:02d}</n:publication_date></n:news></{p}url>"
    sites = body("<urlset>" + url("", 1, 3) + url("", 2, 5) + url("", 1, 9) + url("", 3, 4) + "</urlset>", '<s:urlset xmlns:s="u">' + url("s:", 7, 3) + "</s:urlset>", "<urlset><url>")
    assert [(r.source, r.url[-1], r.category) for r in feeds.sitemap(sites, cut, max_items=2).orderBy("source", F.desc("ts")).collect()] == [("s0", "2", "x"), ("s0", "3", "x"), ("s1", "7", "x")]
    assert [r.source for r in feeds.malformed(sites, "sitemap").collect()] == ["s2"]


def _edits(pattern: str, text: str) -> int:
    """Least edits between the pattern and a substring of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[:], 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(above[i] + 1, row[i - 1] + 1, above[i - 1] + (c != p))
        best = min(best, row[-1])
    return best


def test_fuzzy_search_equals_the_plain_table(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    texts = [word(rng.randint(0, 30)) for _ in range(300)] + ["", "x" * 5000 + "abcdabc"]
    for pattern in ("ab", "abc", "abcdabcd", "dcbaé abcdabcd", "a" * 63):
        most = int(0.4 * len(pattern) + 1e-9)
        assert search.least_errors(texts, pattern, most).tolist() == [min(_edits(pattern, t), most + 1) for t in texts]
    rows = [(i, texts[i], word(4), [word(5), word(6)], None if i % 3 else word(12)) for i in range(200)] + [(999, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, source string, tags array<string>, summary string")
    for query in ("abca", "bcdabc", "ABCDABCDAB"):
        got = {r.id: r.distance for r in search.fuzzy(df, query).collect()}
        want = {}
        for i, t, s, tags, y in rows:
            d = min((_edits(query.lower(), f) for f in [t, s, *(tags or []), y] if f is not None), default=99) / len(query)
            if d <= 0.4:
                want[i] = d
        assert got == pytest.approx(want) and len(want) > 5
    assert search.fuzzy(df, "a").count() == 0 and search.fuzzy(df.limit(0), "abc").count() == 0
    assert search.fuzzy(df.withColumn("title", F.lit("ab" * 50)), "ab" * 40).first().distance == 0


def test_phrases_beat_characters(spark):
    rng = random.Random(9)
    table = {"a": "1", "ab": "2", "abc": "3", "bc": "4", "cab": "5", "bca": "", "発": "發", "頭発": "頭髮"}
    texts = ["".join(rng.choice("abcd頭発") for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None]
    longest = re.compile("|".join(sorted(map(re.escape, table), key=len, reverse=True)))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), feeds.converted(F.col("t"), table).alias("c")).collect()
    assert all(r.c == (None if r.t is None else longest.sub(lambda m: table[m[0]], r.t)) for r in got)


def test_source_history(spark):
    runs = [("a", 1, None), ("a", 2, "x"), ("a", 3, "y" * 200), ("b", 1, "z"), ("b", 2, None), ("c", 1, "w"), ("c", 2, "v")]
    got = {r.source: (r.fail_streak, r.last_success, r.last_error) for r in facets.source_history(spark.createDataFrame(runs, "source string, run int, error string")).collect()}
    assert got == {"a": (2, 1, "y" * 120), "b": (0, 2, ""), "c": (2, None, "v")}


def test_deep_pages_take_linear_time():
    began = time.time()
    deep = "<div onclick='x'>" * 20_000 + "text"
    assert html.sanitised(deep).count("<div>") == 20_000 and html.flow(deep) == [{"text": "text"}]
    assert html.flow("<div>" * 9000 + "</b>" * 9000 + "x") == [{"text": "x"}]
    assert html.rewritten("<noscript>" * 9000 + "<picture>" * 9000 + "<img src='http://a/b'></picture>").endswith('<img src="http://a/b">')
    assert sum(1 for _ in html._each(html.tree(deep))) == 20_000
    assert time.time() - began < 20


def test_key_sentences_as_the_sql_cuts_them(spark, tmp_path):
    import duckdb

    from loomwire.plans import catalogue

    texts = ['token = "55cf1b56d3d0" . “A quoted sentence.” And more', "\u00a0Blank of another kind. \tTab before it\x0bhere? no", "One sentence here.. One sentence here. 「Third one here」!", "Under\x01a mark of another kind", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r["items"] for r in catalogue.QUERIES["key_sentences"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.sql(catalogue.SQL["key_sentences"]).fetchall()) and got[4] == ""


def test_related_candidates_of_a_hot_topic_are_few(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(rank, "written", lambda df, name, own=rank.written: kept.append(own(df, name)) or kept[-1])
    none = F.array().cast("array<string>")
    ages = {f"{i:04d}": i * 37 % 90 for i in range(600)}  # hours; many equally old, many past 72
    rows = spark.createDataFrame([(i, at(h), "hot") for i, h in ages.items()] + [("0600", None, "hot"), ("0601", at(1), "cold")], "id string, ts timestamp, topic string")
    rows = rows.select("*", F.lit(None).cast("string").alias("cluster_id"), F.lit("").alias("event_type"), *(none.alias(c) for c in ("people", "companies", "places", "dates", "numbers")))
    got = sorted((r.id, r.nth, r.other) for r in rank.related(rows.filter("id % 20 = 0"), rows, now()).collect())
    best = sorted(ages, key=lambda i: (ages[i], i))
    assert got == sorted((q, k + 1, o) for q in [f"{i:04d}" for i in range(0, 601, 20)] for k, o in enumerate([o for o in best if o != q][:6]))
    assert kept[0].count() == 8


def test_few_unlike_titles_meet_and_pairs_carry_no_sets(spark):
    from loomwire.plans.views import articles

    points, _ = dedup._points(articles(spark, "/root/testdata/sf0.01"), "ord", "title")
    alike = dedup._similar_points(points, 82)
    met = dedup.meetings(points).distinct().count()
    assert alike.count() == 37 and met <= 45  # 61 by bitmaps of an OR
    joins = [x for x in alike._jdf.queryExecution().optimizedPlan().toString().split("Join ") if "title" in x]
    assert joins and not any("AS gp" in x or "AS gq" in x for x in joins)


def _titles(spark, n):
    """n titles, a third of them near copies or copies of earlier ones, some with signs outside the basic plane or too short; and the bigram sets of those that have one."""
    draw, rows = random.Random(7), []
    for k in range(n):
        title = "".join(draw.choice("abcdefgh\U0001f600é漢\U00020000字 .") for _ in range(draw.choice((0, 1, 2, 8, 40, 60))))
        if k % 3 == 0 and rows:
            title = list(draw.choice(rows)[1])
            for _ in range(draw.randrange(3) if title else 0):
                title[draw.randrange(len(title))] = draw.choice("abcdefgh漢")
            title = "".join(title)
        rows.append((k, title))
    sets = {k: {s[i : i + 2] for i in range(len(s) - 1)} for k, t in rows for s in ["".join(c for c in t.lower() if c.isalnum())]}
    return spark.createDataFrame(rows, "ord int, title string"), {k: s for k, s in sets.items() if s}


def _alike(sets, percent=82):
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * percent}


def test_groups_write_a_title_a_few_times_only(spark, monkeypatch):
    rows, sets = _titles(spark, 240)
    least = {k: k for k in sets}
    links = _alike(sets)
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    linked = {k for pair in links for k in pair}
    held, real = [], dedup.written

    def written(df, name):
        out = real(df, name)
        held.append(sum(len(r[-1]) if isinstance(r[-1], list) else 1 for r in out.collect()))  # a pack holds its points
        return out

    monkeypatch.setattr(dedup, "written", written)
    for name, value in (("PACKED", 7), ("SIDE", 2), ("TILE", 3), ("CHECKED", 5), ("HELD", 4)):
        monkeypatch.setattr(dedup, name, value, raising=False)
    assert dict(map(tuple, dedup.duplicate_groups(rows).collect())) == {k: least[k] for k in linked}
    assert sum(held) <= 4 * len(sets)  # marks were 56 rows for each set


def test_articles_without_content_deal_out_titles_only(spark):
    from loomwire.plans.views import articles

    plan = articles(spark, "/root/testdata/sf0.001").select("ord", "id", "title", "score", "ts")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join ")[1].splitlines()[1]
    assert "AS title" in below and not re.search(r"[\[ ]text#\d+[,\]]", below)  # the whole text went through the join


def test_best_copies_of_many_titles(spark):
    rows, sets = _titles(spark, 120)
    rows = rows.select("ord", F.concat(F.lit("i"), "ord").alias("id"), "title", F.pmod(F.col("ord") * 7, F.lit(5)).alias("score"), F.lit(NOW).alias("ts"))
    group = dict(map(tuple, dedup.duplicate_groups(rows).collect()))
    members = {g: sorted((k for k in group if group[k] == g), key=lambda k: (-(k * 7 % 5), k)) for g in group.values()}
    want = {f"i{k}": (None, len(m)) if k == m[0] else (f"i{m[0]}", None) for m in members.values() for k in m}
    got = {r.id: (r.duplicate_of, r.duplicate_count) for r in dedup.mark_duplicates(rows).filter("duplicate_of is not null or duplicate_count is not null").collect()}
    assert got == want and {k for p in _alike(sets) for k in p} == set(group)


def test_pairs_are_compared_where_packs_meet(spark):
    rows, sets = _titles(spark, 150)
    pairs = dedup.similar_pairs(rows)
    got = {(r.a, r.b): r.jaccard for r in pairs.collect()}
    want = _alike(sets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "array_intersect" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # titles were dealt out for each pair
