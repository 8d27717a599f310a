"""Streams that are stopped and started again, and state that ends."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwire.operators import clusters
from loomwire.plans.streams import fresh_dir, in_parts
from loomwire.sources import payload
from loomwire.sources.conditional import Answer, ConditionalFeeds, _Polls, after, validators
from loomwire.sources.tables import KeyedTable, carry_over
from loomwire.streaming import jobs

SCHEMA = "feed string, poll long, status int, etag string, last_modified string, body string"


def test_validators_after_answers():
    had = {"a": Answer(200, "v1", None), "b": Answer(200, None, "Mon")}
    now = after(had, {"a": Answer(304, "v1", None), "b": Answer(503, None, None, "HTTP 503"), "c": Answer(200, "x")})
    assert now == {"a": Answer(304, "v1", None), "b": Answer(503, None, "Mon", "HTTP 503"), "c": Answer(200, "x")}
    assert after(now, {"a": Answer(200)})["a"] == Answer(200, None, None)


def poll(spark, responses, out, checkpoint):
    spark.dataSource.register(ConditionalFeeds)
    stream = spark.readStream.format("conditional_feeds").option("responses", f"file://{responses}").load()
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    running.processAllAvailable()
    running.stop()
    return sorted((r.poll, r.source, r.status, r.body, r.error) for r in spark.read.schema(stream.schema).parquet(out).collect())


def test_a_restarted_stream_repeats_no_body(spark, tmp_path):
    responses = str(tmp_path / "responses")
    land = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(responses)
    out, checkpoint = fresh_dir(spark, "polled"), fresh_dir(spark, "polled-checkpoint")
    land(("a", 1, 200, "v1", None, "A1"), ("b", 1, 200, None, "Mon", "B1"), ("c", 1, 200, None, None, "C"))
    land(("a", 2, 200, "v1", None, "A1"), ("b", 2, 404, None, None, None), ("c", 2, 200, None, None, "C"))
    first = poll(spark, responses, out, checkpoint)
    assert first == [(1, "a", 200, "A1", None), (1, "b", 200, "B1", None), (1, "c", 200, "C", None), (2, "a", 304, None, None), (2, "b", 404, None, "HTTP 404"), (2, "c", 200, "C", None)]
    assert poll(spark, responses, out, checkpoint) == first
    land(("a", 3, 200, "v2", None, "A2"), ("b", 3, 200, None, "Mon", "B1"))
    land(("a", 4, 200, "v2", None, "A2"))
    assert poll(spark, responses, out, checkpoint) == [*first, (3, "a", 200, "A2", None), (3, "b", 304, None, None), (4, "a", 304, None, None)]
    rows = spark.read.parquet(out)
    assert {tuple(r) for r in validators(rows).filter("feed <> 'c'").collect()} == {("a", "v2", None, 304), ("b", None, "Mon", 304)}
    assert rows.filter(F.col("not_modified")).count() == 3


def test_polls_with_gaps_are_few_batches_of_few_tasks(tmp_path):
    (tmp_path / "responses").mkdir()
    said = [{"feed": f, "poll": k * 1_000_000, "status": 200, "etag": f"v{k}", "last_modified": None, "body": f"{f}{k}"} for k in range(1, 501) for f in "abcdef"]
    schema = pa.schema([("feed", pa.string()), ("poll", pa.int64()), ("status", pa.int32()), ("etag", pa.string()), ("last_modified", pa.string()), ("body", pa.string())])
    for i in range(3):
        pq.write_table(pa.Table.from_pylist(said[i::3], schema), tmp_path / "responses" / f"{i}.parquet")
    polls = _Polls({"responses": f"file://{tmp_path}/responses"})
    end = polls.latestOffset()
    assert end["poll"] == 500_000_000 and len(parts := polls.partitions(polls.initialOffset(), end)) == 2
    polls.commit(end)
    assert polls.latestOffset() == end
    assert sorted((r[0], r[1], r[7]) for p in parts for r in polls.read(p)) == sorted((r["feed"], r["poll"], r["body"]) for r in said)


def test_a_stream_that_is_behind_takes_many_polls_in_a_batch(spark, tmp_path):
    said = [("a", k, 503 if k % 7 == 0 else 200, f"v{k // 3}", None, f"A{k}") for k in range(1, 301)] + [("b", k, 200, None, None, f"B{k}") for k in range(1, 301, 2)]
    spark.createDataFrame(said, SCHEMA).repartition(5).write.parquet(str(tmp_path / "responses"))
    spark.dataSource.register(ConditionalFeeds)
    stream = spark.readStream.format("conditional_feeds").option("responses", f"file://{tmp_path}/responses").load()
    running = stream.writeStream.format("memory").queryName("behind").start()
    running.processAllAvailable()
    batches = {p["batchId"] for p in running.recentProgress if p["numInputRows"]}
    running.stop()
    had, want = {}, []
    for feed, k, status, etag, _, body in sorted(said, key=lambda r: r[1]):
        same = status == 200 and etag is not None and had.get(feed) == etag
        want.append((feed, k, 304 if same else status, None if same or status != 200 else body))
        had |= {feed: etag} if status == 200 else {}
    got = [(r.source, r.poll, r.status, r.body) for r in spark.table("behind").collect()]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)] and {r for r in got} == {r for r in want} and len(batches) == 1


def test_alerts_are_forgotten(spark, tmp_path):
    """Topics that fall silent leave no state, and what alerts is the same as in one pass over all rows."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for day in range(16):
        for topic in ["always", f"day{day}"]:
            rows += [(topic, start + dt.timedelta(days=day, minutes=rng.randint(0, 1439)), f"{topic}-{day}-{k}", day // 4) for k in range(5)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp, id string, part int")
    stream = in_parts(spark, df, F.col("part"))
    name = "alerts_that_end"
    running = jobs.alert_once(stream, "1 hour").writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="0 seconds").start()
    running.processAllAvailable()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    running.stop()
    want = []
    for topic in {r[0] for r in rows}:
        last = None
        for _, ts, id_, _ in sorted(r for r in rows if r[0] == topic):
            if last is None or ts > last + dt.timedelta(hours=48):
                want.append((topic, id_))
                last = ts
    assert sorted((r.topic, r.id) for r in spark.table(name).collect()) == sorted(want)
    assert len(want) > 20 and kept[-1] <= 10  # a value and a timer each; 17 topics in all


def test_keyed_table_survives_a_killed_batch(spark):
    schema = "k string, v int, at int"
    rows = [(f"k{i % 13}", i, i // 10) for i in range(80)]
    whole = spark.createDataFrame(rows, schema)
    state = KeyedTable(spark, fresh_dir(spark, "keyed"), schema, ["k"], ["at", "v"], 4)
    stream, checkpoint, killed = in_parts(spark, whole, F.floor(F.col("at") / 2)), fresh_dir(spark, "keyed-checkpoint"), []

    def apply(batch, number):
        if number == 2 and not killed:
            killed.append(number)
            publish, state._publish = state._publish, lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))  # rows are written, the manifest isn't
            try:
                state.upsert(batch, number)
            finally:
                state._publish = publish
        assert state.upsert(batch, number) is (number not in done)
        done.add(number)

    done: set[int] = set()
    with pytest.raises(Exception, match="killed"):
        jobs.each_batch(stream, apply, checkpoint).awaitTermination()
    assert state.batches() == [0, 1] and max(r.at for r in state.read().collect()) == 3
    jobs.each_batch(stream, apply, checkpoint).awaitTermination()
    want = {k: max((a, v) for q, v, a in rows if q == k) for k in {r[0] for r in rows}}
    assert {r.k: (r.at, r.v) for r in state.read().collect()} == want and state.batches() == [0, 1, 2, 3]
    assert not state.upsert(whole, 3) and max(r.at for r in state.read(1).collect()) == 3
    state.forget(1)
    assert state.batches() == [3] and state.read().count() == 13
    assert KeyedTable(spark, fresh_dir(spark, "none"), schema, ["k"], ["at"]).read().count() == 0


def test_only_touched_buckets_are_written(spark):
    state = KeyedTable(spark, fresh_dir(spark, "touched"), "k int, v int", ["k"], ["v"], 32)
    state.upsert(spark.range(500).selectExpr("cast(id as int) k", "1 v"), 0)
    state.upsert(spark.createDataFrame([(7, 2), (7, 0)], "k int, v int"), 1)
    assert sum(b == 1 for b in state.manifest().values()) == 1 and state.read().filter("v = 2").count() == 1 and state.read().count() == 500


def test_silent_sources_are_carried_over(spark):
    schema = "source string, id string, ts int"
    state = KeyedTable(spark, fresh_dir(spark, "carry"), schema, ["source"], ["ts"], 2)
    merge = carry_over(F.lit(5))
    state.upsert(spark.createDataFrame([("a", "1", 9), ("a", "2", 9), ("b", "3", 9), ("b", "4", 5), ("c", "5", 9)], schema), 0, merge)
    state.upsert(spark.createDataFrame([("a", "6", 9), ("c", "7", 9)], schema), 1, merge)
    assert {r.id for r in state.read().collect() if r.source != "b" or r.ts > 5} == {"6", "7", "3"}


def test_an_aborted_payload_leaves_the_old_one(spark, tmp_path):
    uri = f"file://{tmp_path}/published"
    rows = spark.createDataFrame([("1", "long", 3), ("2", None, 4)], "id string, content string, score int")
    assert payload.current(uri) is None and payload.read(spark, uri, "articles", "id string").count() == 0
    payload.publish(uri, articles=rows, stats=rows.groupBy().count())
    first = payload.current(uri)
    bad = F.udf(lambda i: 1 // (int(i) - 2), "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        payload.publish(uri, articles=rows.withColumn("score", bad("id")))
    assert payload.current(uri) == first
    assert sorted(map(tuple, payload.read(spark, uri, "articles", "id string, score int, content string").collect())) == [("1", 3, None), ("2", 4, None)]
    payload.publish(uri, articles=rows.filter("id = '2'"))
    assert len([p for p in (tmp_path / "published").iterdir() if p.name.startswith("snapshot")]) == 2  # this one and the one before
    assert payload.read(spark, uri, "articles", "id string").count() == 1 and payload.read(spark, uri, "stats", "count long").count() == 0


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_signatures_over_many_tasks(spark, chunk):
    rows = [("big", f"id{i:05d}") for i in range(3000)] + [("two", "b"), ("two", "a"), (None, "x"), ("none", None)] + [(f"c{i}", "z") for i in range(50)]
    df = spark.createDataFrame(rows, "cluster_id string, id string").repartition(7)
    got = {r.cluster_id: r.signature for r in clusters.signatures(df, chunk=chunk).collect()}
    want = {k: "|".join([k, *sorted(i for c, i in rows if c == k and i)]) for k in {c for c, i in rows if c and i}}
    assert got == {k: hashlib.md5(t.encode()).hexdigest()[:12] for k, t in want.items()}


def test_sketches_stay_near(spark):
    rows = spark.range(60_000).selectExpr("timestamp'2024-01-01 00:10:00' ts", "cast(id % 30000 as string) source", "'t' topic", "5 score")
    many = jobs.bursts(rows, slide="2 hours").first()
    assert abs(many.n_sources - 30_000) < 30_000 * 0.05
    few = jobs.bursts(rows.limit(40).selectExpr("ts", "topic", "cast(cast(source as int) % 20 as string) source"), slide="2 hours").first()
    assert few.n_sources == 20
    hot = jobs.trend(rows, "4 hours", "4 hours").first()
    assert hot.avg_score == 5.0 and hot.heat == pytest.approx(8 * hot.n + 5 * hot.n_sources + 15 + 2 * (4 - 3 - 50 / 60), abs=0.01)


@pytest.mark.parametrize("name", ["stream_bursts", "window_bursts"])
def test_bursts_count_many_sources_exactly(spark, tmp_path, name):
    """Thousands of users in a window, some in several slots of it, and rows without a user or a time."""
    import duckdb

    from loomwire.plans import catalogue

    rows = spark.range(30_000).selectExpr("id event_id", "if(id % 997 = 0, null, timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(0, 0, int(id % 7) * 25)) ts", "if(id % 501 = 0, null, id % 9001) user_id", "if(id % 3 = 0, 'a', 'b') event_type", "1.0D value", "'{}' props")
    rows.coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)), duck.sql(catalogue.SQL[name])
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
