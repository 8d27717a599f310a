"""Mixing sources to target weights, by built-in SQL functions only.

A source's target is its share by weight of `share` times all sizes, at most `cap` times its own size;
what the cap takes off is shared again by weight among the others until none is above.

Documents are permuted by a hash of their ids and dealt into blocks of a source. A target of up to one
size is one pass over the source's permuted blocks, a larger one a second pass: a pass takes whole
blocks in order, then whole documents of one more block, then part of one document, so that the words
taken are the target to less than one word. A source's quota is the number of blocks a pass takes of it. A binary
tree splits the quotas of all sources among output shards, each node by the multivariate hypergeometric law; then every
shard draws its quotas from the permuted blocks, which are disjoint, and shuffles within. The number of
shards is a parameter; `shard_levels` is its default rule.

Statistics come from all rows. No window holds a source's documents: sums over documents are made within blocks, sums
and the tree over blocks, which are `most_blocks` and one for each source at most. Sources are numbered by ranges.
Null and empty texts have size 0 and are taken 0 words. Null sources are one source, the last. Null ids hash as
the word null; of repeated rows each counts; rows alike in id and size may swap their words. Extra columns are
ignored by `plan` and kept by `mixed`. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.operators.rank import numbered

from .common import WORD, any_names, bounded, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
LEVELS, SHARD_DOCS, MOST_LEVELS = 6, 4096, 16  # 64 shards at least, then one for each SHARD_DOCS documents
BLOCK_DOCS, MOST_BLOCKS = 512, 65536
SEED = "mix"


def hashed(*parts: Column | str) -> Column:
    """60 bits of the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, docs -> with weight and target. One row for each source.

    Sources above their cap are set to it and what that takes off is shared again, until none is above: each
    turn is one sum over the sources.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_nth")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_nth") - 1, F.lit(len(weights))).cast("int"))
    ranked = written(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).drop("_nth"), "mix-sources")
    ratio = F.col("most") / F.col("weight")
    level, capped = 0.0, -1
    while True:
        over = ratio < F.lit(level)
        r = ranked.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)).first()
        if not r[2] or r[3] == capped:
            break
        level, capped = (r[0] * float(share) - r[1]) / float(r[2]), r[3]
    most = F.col("most").cast("double")
    target = F.least(most, F.lit(level) * F.col("weight")) if r[2] else most
    return ranked.select("source", "source_size", "docs", "weight", target.alias("target"))


def shard_levels(n_docs: int) -> int:
    """The default number of levels of the tree: one shard for each SHARD_DOCS documents, a power of two, between 2**LEVELS and 2**MOST_LEVELS."""
    return min(MOST_LEVELS, max(LEVELS, (n_docs // SHARD_DOCS).bit_length()))


def _quotas(passes: DataFrame, levels: int, seed: str) -> DataFrame:
    """source, pass, shard, n: how many of the blocks that a pass takes of a source each shard gets.

    The root of the tree has the sources' whole quotas. Every node draws one half of its blocks' places at random for its
    left child, so that the quotas of the two halves have the multivariate hypergeometric law.
    """
    counts = passes.groupBy("source", "pass").agg(F.count("*").alias("n"))
    node = counts.select("source", "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).withColumn("shard", F.lit(0))
    for level in range(levels):
        key = hashed(seed, F.lit(str(level)), F.coalesce(F.col("source"), F.lit("null")), F.col("source").isNull().cast("string"), F.col("k").cast("string"), F.col("pass").cast("string"))
        within = Window.partitionBy("shard")
        left = F.row_number().over(within.orderBy(key, F.col("source").asc_nulls_last(), "k", "pass")) <= F.ceil(F.count("*").over(within) / 2)
        node = node.withColumn("left", left).withColumn("shard", F.col("shard") * 2 + F.when(F.col("left"), 0).otherwise(1)).drop("left")
    return node.groupBy("source", "pass", "shard").agg(F.count("*").alias("n"))


def _tree(passes: DataFrame, levels: int, seed: str) -> DataFrame:
    """passes with a shard each: the quotas are drawn from the permuted blocks of each source, without replacement."""
    quotas = _quotas(passes, levels, seed)
    key = hashed(seed, F.lit("draw"), F.coalesce(F.col("source"), F.lit("null")), F.col("source").isNull().cast("string"), F.col("block").cast("string"), F.col("pass").cast("string"))
    permuted = passes.withColumn("nth", F.row_number().over(Window.partitionBy("source", "pass").orderBy(key, "block")))
    places = quotas.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("nth", F.row_number().over(Window.partitionBy("source", "pass").orderBy("shard", "_k")))
    places = places.select(F.col("source").alias("_source"), F.col("pass").alias("_pass"), F.col("nth").alias("_nth"), "shard")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("pass") == F.col("_pass")) & (F.col("nth") == F.col("_nth"))
    return permuted.join(places, same).drop("_source", "_pass", "_nth", "nth")


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, levels: int | None = None, block_docs: int = BLOCK_DOCS, most_blocks: int = MOST_BLOCKS, seed: str = SEED, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken; shard, taken_first and shard_again, taken_again of the two passes (shard -1: not taken)."""
    sized = written(docs.select("doc_id", "source", n_words(text).alias("size"), hashed(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    each = F.greatest(F.lit(block_docs), F.floor(F.sum("docs").over(Window.partitionBy()) / most_blocks))
    aimed = written(targets(sources, weights, share, cap).withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("docs") / each)).cast("long")).withColumn("quota", F.floor("target")), "mix-targets")
    aimed_small = bounded(aimed)
    dealt = sized.alias("d").join(aimed_small.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target", "quota", F.pmod("h", F.col("blocks")).alias("block"))
    blocks = dealt.groupBy("source", "block", "source_size", "quota").agg(F.sum("size").alias("block_size"))
    so_far = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_size").over(so_far), F.lit(0)))
    # pass 0 has what fits in the source once, pass 1 the rest
    first = F.least("quota", "source_size")
    passes = blocks.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("left", F.when(F.col("pass") == 0, first).otherwise(F.col("quota") - first) - F.col("before")).filter((F.col("left") > 0) & (F.col("block_size") > 0))
    if levels is None:
        levels = shard_levels(sized.count())
    shards = _tree(passes.select("source", "block", "pass", F.least("left", "block_size").alias("block_taken"), (F.col("left") < F.col("block_size")).alias("cut")), levels, seed)
    ways = written(
        shards.groupBy("source", "block").agg(
            *(F.max(F.when(F.col("pass") == p, F.col(c))).alias(f"{c}{p}") for p in (0, 1) for c in ("shard", "block_taken", "cut"))
        ),
        "mix-blocks",
    )
    w = bounded(ways).alias("w")
    met = dealt.alias("d").join(w, F.col("d.source").eqNullSafe(F.col("w.source")) & (F.col("d.block") == F.col("w.block")), "left").select(
        "d.doc_id", "d.source", "d.size", "d.h", "d.block", "source_size", "target", *(f"{c}{p}" for p in (0, 1) for c in ("shard", "block_taken", "cut"))
    )
    cut = F.coalesce(F.col("cut0"), F.lit(False)) | F.coalesce(F.col("cut1"), F.lit(False))
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = met.filter(~cut).withColumn("start", F.lit(0).cast("long"))
    parts = met.filter(cut).withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    took = lambda p: F.when(F.col(f"cut{p}"), F.greatest(F.lit(0), F.least(F.col("size"), F.col(f"block_taken{p}") - F.col("start")))).when(F.col(f"shard{p}").isNotNull(), F.col("size")).otherwise(0).cast("long")
    return (
        whole.unionByName(parts)
        .withColumns({"taken_first": took(0), "taken_again": took(1)})
        .select("doc_id", "source", "size", "source_size", "target", (F.col("taken_first") + F.col("taken_again")).alias("taken"), F.when(F.col("taken_first") > 0, F.col("shard0")).otherwise(-1).alias("shard"), F.when(F.col("taken_again") > 0, F.col("shard1")).otherwise(-1).alias("shard_again"), "taken_first", "taken_again")
    )


@any_names("doc_id", "text", "source")
def mixed(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each pass that takes at least half of a document's words, dealt to shards and shuffled within.

    Documents come whole: the one document of a source and pass of which only a part is taken is rounded to all or nothing.
    Rows with one doc_id are dealt as one document: each of them comes once a pass.
    """
    spark = docs.sparkSession
    took = plan(docs, seed=seed, **options)
    half = lambda c: F.col(c) * 2 >= F.col("size")
    turns = took.filter(F.col("taken") > 0).select(
        F.col("doc_id").alias("_doc"),
        F.explode(F.filter(F.array(F.when(half("taken_first") & (F.col("taken_first") > 0), F.struct(F.lit(0).alias("turn"), F.col("shard").alias("shard"))), F.when(half("taken_again") & (F.col("taken_again") > 0), F.struct(F.lit(1).alias("turn"), F.col("shard_again").alias("shard")))), lambda x: x.isNotNull())).alias("_at"),
    )
    turns = bounded(written(turns.distinct(), "mix-turns"))
    drawn = docs.join(turns, docs["doc_id"].eqNullSafe(turns["_doc"]))
    key = hashed(seed, F.col("_at.turn").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return drawn.repartition(n, F.col("_at.shard")).sortWithinPartitions("_at.shard", key).select(*(docs[c] for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for plan() with its default parameters and its default rule for the number of shards."""
    h = lambda *x: "('0x' || substr(md5(" + " || '|' || ".join(x) + "), 1, 15))::BIGINT"
    source = ("coalesce(source, 'null')", "CASE WHEN source IS NULL THEN 'true' ELSE 'false' END")
    tree = ""
    for k in range(MOST_LEVELS):
        key = h(f"'{SEED}'", f"'{k}'", *source, "k::VARCHAR", "pass::VARCHAR")
        half = f"CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY {key}, source NULLS LAST, k, pass) <= ceil(count(*) OVER (PARTITION BY shard) / 2) THEN 0 ELSE 1 END"
        tree += f""", node{k + 1} AS (SELECT * EXCLUDE (shard), {f"shard * 2 + {half}" if k < LEVELS else f"CASE WHEN {k} < (SELECT l FROM deep) THEN shard * 2 + {half} ELSE shard END"} AS shard FROM node{k})"""
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, {h(f"'{SEED}'", "coalesce(doc_id::VARCHAR, 'null')")} AS h FROM documents
), deep AS (SELECT least({MOST_LEVELS}, greatest({LEVELS}, length(bin(count(*) // {SHARD_DOCS})))) AS l FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * {CAP} AS most, (source_size * {CAP})::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(source_size * {CAP}) OVER (ORDER BY (source_size * {CAP})::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY (source_size * {CAP})::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM weighed
), aimed AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, (SELECT arg_min(level, ratio) FROM ranked WHERE level <= ratio) * weight), most::DOUBLE) AS target,
    greatest(1, docs // greatest({BLOCK_DOCS}, sum(docs) OVER () // {MOST_BLOCKS}))::BIGINT AS blocks FROM ranked
), dealt AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS quota, h % blocks AS block FROM sized d JOIN aimed t ON d.source IS NOT DISTINCT FROM t.source
), per_block AS (
  SELECT source, block, any_value(source_size) AS source_size, any_value(quota) AS quota, sum(size)::BIGINT AS block_size FROM dealt GROUP BY source, block
), placed AS (
  SELECT *, coalesce(sum(block_size) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM per_block
), passes AS (
  SELECT source, block, pass, CASE WHEN pass = 0 THEN least(quota, source_size) ELSE quota - least(quota, source_size) END - before AS room, block_size FROM placed, (VALUES (0), (1)) p(pass) WHERE room > 0 AND block_size > 0
), node0 AS (
  SELECT source, pass, row_number() OVER (PARTITION BY source, pass) - 1 AS k, 0 AS shard FROM passes
){tree}, places AS (
  SELECT source, pass, shard, row_number() OVER (PARTITION BY source, pass ORDER BY shard) AS nth FROM node{MOST_LEVELS}
), permuted AS (
  SELECT *, row_number() OVER (PARTITION BY source, pass ORDER BY {h(f"'{SEED}'", "'draw'", *source, "block::VARCHAR", "pass::VARCHAR")}, block) AS nth FROM passes
), drawn AS (
  SELECT b.source, b.block, b.pass, b.room, p.shard FROM permuted b JOIN places p ON p.source IS NOT DISTINCT FROM b.source AND p.pass = b.pass AND p.nth = b.nth
), summed AS (
  SELECT d.doc_id, d.source, d.size, d.source_size, d.target, a.shard AS s0, b.shard AS s1, a.room AS r0, b.room AS r1,
    coalesce(sum(d.size) OVER (PARTITION BY d.source, d.block ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM dealt d LEFT JOIN drawn a ON a.pass = 0 AND a.source IS NOT DISTINCT FROM d.source AND a.block = d.block LEFT JOIN drawn b ON b.pass = 1 AND b.source IS NOT DISTINCT FROM d.source AND b.block = d.block
), took AS (
  SELECT *, CASE WHEN r0 IS NULL THEN 0 ELSE greatest(0, least(size, r0 - start)) END::BIGINT AS taken_first, CASE WHEN r1 IS NULL THEN 0 ELSE greatest(0, least(size, r1 - start)) END::BIGINT AS taken_again FROM summed
)
SELECT doc_id, size, source_size, target, taken_first + taken_again AS taken, CASE WHEN taken_first > 0 THEN s0 ELSE -1 END::INT AS shard, CASE WHEN taken_again > 0 THEN s1 ELSE -1 END::INT AS shard_again FROM took
"""
