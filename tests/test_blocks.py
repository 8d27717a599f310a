"""Composed blocks, injected calls, and the remaining sources."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwire.functions import models
from loomwire.operators import dashboard
from loomwire.sources import feeds, sinks

NOW = dt.datetime(2026, 4, 21, 12)


class Gone(Exception):
    status = 404


class Busy(Exception):
    status = 429


def test_attempts_stop_at_lasting_errors():
    calls = []

    def call(error, good_at):
        def one(prompts):
            calls.append(prompts)
            if len(calls) < good_at:
                raise error
            return [p.upper() for p in prompts]

        calls.clear()
        return one

    waits: list[float] = []
    assert models.attempt(call(Busy(), 3), ["a"], sleep=waits.append) == ["A"] and waits == [1.0, 2.0]
    assert models.attempt(call(Gone(), 3), ["a"], sleep=waits.append) is None and len(calls) == 1
    assert models.attempt(call(TimeoutError(), 9), ["a"], sleep=lambda s: None) is None and len(calls) == 4
    assert models.attempt(lambda p: [], ["a"], sleep=lambda s: None) is None
    assert models.version("a") != models.version("b") and len(models.version("a")) == 10


def test_ask_and_embed(spark):
    def call(prompts):
        if len(prompts) > 1 and "bad" in prompts:
            raise ValueError("no")
        return [None if p == "bad" else p[::-1] for p in prompts]

    rows = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "cd")], "id int, prompt string").coalesce(1)
    assert sorted((r.id, r.answer) for r in models.ask(rows, call, "id", "prompt", pause=0).collect()) == [(1, "ba"), (2, None), (3, "dc")]
    got = models.embed(rows, lambda ts: [[float(len(t)), 0.0, 1.0] for t in ts], "id", "prompt").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got) and len({r.text_hash for r in got}) == 3


def test_texts_and_defaults(spark):
    r = spark.range(1).select(models.article_text(F.lit(" "), F.lit("<p>feed</p>"), F.lit("t")).alias("a"), models.embedding_text(F.lit("t"), F.lit(None).cast("string")).alias("e")).first()
    assert (r.a, r.e) == ("feed", "t")
    d = models.with_defaults(spark.createDataFrame([(None,), (7,)], "score int")).orderBy("score").collect()
    assert [(x.score, x.sentiment, x.tags) for x in d] == [(5, "neutral", []), (7, "neutral", [])]


def test_facts_and_reasons(spark):
    e = F.struct(*(F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in {"people": ["a", "b", "c", "d", "e"], "companies": ["f"], "places": [], "dates": [], "numbers": []}.items()))
    r = spark.range(1).select(dashboard.facts(F.lit("vote"), e).alias("f"), dashboard.alert_reason(F.lit(False), F.lit(7), F.array(F.lit("thin"))).alias("r")).first()
    assert [x.value for x in r.f] == ["vote", "a", "b", "c", "d", "f"] and r.r == "thin"


def test_angles_and_cluster_summary(spark):
    rows = spark.createDataFrame([("c", "s1", "positive", 1, ["A point", "b"]), ("c", "s1", "negative", 2, ["a  POINT", "d"]), ("c", "s2", None, 3, [])], "cluster_id string, source string, sentiment string, ord int, points array<string>")
    angles = spark.createDataFrame([("c", "x", ["s2", "s1"]), ("c", "y", ["s9"])], "cluster_id string, label string, sources array<string>")
    assert {(r.label, r.sentiment) for r in dashboard.angle_sentiment(rows, angles).collect()} == {("x", "negative"), ("y", "neutral")}
    s = dashboard.cluster_summary(rows).first()
    assert (s.n, s.positive, s.negative, s.points) == (3, 1, 1, ["A point", "b", "d"])
    digests = spark.sql("SELECT 'c' cluster_id, named_struct('timeline', array(1, 2), 'contradictions', array()) digest")
    assert tuple(dashboard.indicators(digests).first()) == ("c", True, False)


def test_similar_first_then_related(spark):
    s = spark.createDataFrame([("q", f"s{i}", i) for i in range(1, 6)], "id string, other string, nth int")
    r = spark.createDataFrame([("q", "s1", 1), ("q", "r1", 2), ("q", "r2", 3), ("q", "r3", 4)], "id string, other string, nth int")
    assert [x.other for x in dashboard.similar_then_related(s, r).orderBy("position").collect()] == ["s1", "s2", "s3", "s4", "r1", "r2"]


def test_pool_expansion_and_memory(spark):
    rows = spark.createDataFrame([("a", "s", None, NOW, "c"), ("b", "m", None, NOW, "c"), ("d", "s", "a", NOW, "c"), ("e", "s", None, NOW - dt.timedelta(hours=30), None)], "id string, source string, duplicate_of string, ts timestamp, cluster_id string")
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp")
    muted = spark.createDataFrame([("m",)], "source string")
    assert [r.id for r in dashboard.pool(rows, muted, now, 24).collect()] == ["a"]
    assert [r.id for r in dashboard.expand(rows, "c").collect()] == ["a", "b", "d"]
    assert dashboard.forget_old(rows, now).count() == 3
    assert tuple(dashboard.failures(spark.createDataFrame([("x",), (None,)], "error string")).first()) == (1, 2)


def test_pages_and_sitemap_walk(spark):
    page = '<input type="hidden" id="title" value="T &amp; U"><meta property="section" content="news"><input name="date" value="2026-04-21 10:00:00">'
    cut = F.lit("2026-04-20 06:00:00").cast("timestamp")
    files = spark.createDataFrame([("s", "http://x/1", page), ("s", "http://x/2", page.replace("news", "sport"))], "source string, url string, body string")
    assert [(r.title, r.ts.hour) for r in feeds.read(files, "pages", cut, section="news").collect()] == [("T & U", 10)]
    web = {"r": "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>", "b": "<urlset><url><loc>1</loc></url><url><loc>2</loc></url></urlset>"}
    web |= {"loop": "<sitemapindex><sitemap><loc>loop</loc></sitemap></sitemapindex>", "bad": "<broken", "bare": "<sitemapindex/>"}
    bodies = spark.createDataFrame([*web.items()], "url string, body string")
    roots = spark.createDataFrame([(k, k) for k in ("r", "b", "none", "loop", "bad", "bare")], "source string, url string")
    walked = lambda **o: sorted((r.source, r.pos, r.url) for r in feeds.walk_sitemaps(roots, bodies, **o).collect())
    assert walked() == [("b", 0, "1"), ("b", 1, "2"), ("r", 0, "1"), ("r", 1, "2")]
    assert walked(most=1, levels=1) == [("b", 0, "1")]


def test_snapshot_may_be_absent(spark, tmp_path):
    assert feeds.snapshot(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "s.json").write_text('{"id": "a"}\nbroken\n')
    assert [r.id for r in feeds.snapshot(spark, str(tmp_path / "s.json"), "id string").filter("id IS NOT NULL").collect()] == ["a"]
    assert spark.range(1).select(feeds.converted(F.lit("国家"), {"国": "國"}).alias("c")).first().c == "國家"


@pytest.mark.parametrize("error", [None, "boom"])
def test_run_metrics(spark, error):
    steps = spark.createDataFrame([("fetch", NOW, NOW + dt.timedelta(seconds=1.26), error)], "step string, started timestamp, ended timestamp, error string")
    r = sinks.run_metrics(steps).first()
    assert r.ok is (error is None) and r.seconds == 1.3
