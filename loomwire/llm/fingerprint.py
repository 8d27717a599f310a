"""Exact fingerprints of canonical texts, by built-in SQL functions only.

Canonical: Unicode compatibility composition, full case folding, composition again, runs of white space
as one blank, none at the ends. The fingerprint is two differently seeded xxHash64 values as 32 hex
digits. Documents in one bucket of equal hashes are compared byte by byte with the bucket's first
document; one that differs gets a digest of its own text added, so that unequal canonical texts don't
share a fingerprint and equal ones always do. Likeness is 1 for equal fingerprints, else 0.

Ids are of any type that has an order. Null texts count as empty. Null ids come last in the order of documents. Rows
with one id are ordered by their texts; equal rows tie and get equal results. A single document follows itself. Very
long texts only cost their length. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

SPACE = r"[\s\x85\xA0  -     　]+"
#: Documents of one bin of ids, whose texts are sorted together.
BIN_DOCS = 1000
#: Ids in the sample that cuts the bins, and the most cells it cuts; cells of whole numbers are cut on, evenly, into so many bins at most in all.
SAMPLE, MOST_CELLS, MOST_BINS = 65_536, 4096, 100_000
#: Bounds of cells that are compared at a time.
STEP = 64
#: Rows of one bucket that are compared together.
PART_DOCS = 256


def canonical(text: Column) -> Column:
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), SPACE, " "))


def hashes(canon: str, one: str, two: str) -> list[Column]:
    return [F.xxhash64(canon).alias(one), F.xxhash64(F.lit(0x5EED), canon).alias(two)]


def printed(one: str, two: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in (one, two))))


def unequal_members(docs: DataFrame, buckets: DataFrame, hashed: DataFrame) -> DataFrame:
    """Rows (doc_id, h1, h2, odd) of documents whose canonical text isn't that of their bucket's first.

    buckets: h1, h2, the first id and n, the number of rows, of every bucket with two rows or more; hashed: doc_id, h1, h2
    of all documents. Only texts of such buckets are made canonical again. A large bucket is dealt into parts of
    about PART_DOCS rows, to each of which its first text is sent.
    """

    def texts_of(ids: DataFrame) -> DataFrame:
        texts = docs.alias("d").join(bounded(ids).alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))).select("d.doc_id", "text")
        return texts.select("doc_id", canonical(F.col("text")).alias("canon")).select("doc_id", "canon", *hashes("canon", "h1", "h2"))

    parts = F.floor(F.col("n") / PART_DOCS) + 1
    ids = written(hashed.join(bounded(buckets), ["h1", "h2"]).select("doc_id").distinct(), "fingerprint-members")
    members = texts_of(ids).join(bounded(buckets), ["h1", "h2"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
    firsts = texts_of(buckets.select(F.col("first").alias("doc_id")).distinct()).join(bounded(buckets), ["h1", "h2"])
    firsts = firsts.filter(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("h1", "h2").agg(F.min("canon").alias("first_canon"), F.max("n").alias("n"))
    firsts = written(firsts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n"), "fingerprint-firsts")
    unequal = F.col("canon").cast("binary") != F.col("first_canon").cast("binary")
    return members.join(firsts, ["h1", "h2", "part"]).filter(unequal).select("doc_id", "h1", "h2", F.substring(F.sha2("canon", 256), 1, 16).alias("odd")).distinct()


def _bin(docs: DataFrame) -> Column:
    """The bin of doc_id, whose order is that of the ids; null ids are in the last.

    A sample of ids, drawn by their hash and of bounded size, cuts them into cells of about as many documents each, so
    that no outlier widens a cell; cells of whole numbers are cut on into equally wide bins. A cell is found
    by two rounds of comparisons with at most STEP bounds.
    """
    n = docs.count()
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = max(1, n // SAMPLE)
    drawn = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("doc_id").distinct().orderBy("doc_id")
    ids = [r[0] for r in drawn.limit(2 * SAMPLE).collect()]
    cells = max(1, min(MOST_CELLS, n // BIN_DOCS + 1, len(ids)))
    bounds = [ids[len(ids) * k // cells] for k in range(1, cells)]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    at, last = F.col("doc_id"), F.lit((cells + 1) * MOST_BINS).cast("long")
    if not bounds:
        return F.when(at.isNull(), last).otherwise(F.lit(0).cast("long"))
    array = lambda values: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= at))
    block = F.greatest(below(array(bounds[::STEP])) - 1, F.lit(0)) * STEP
    cell = (block + below(F.slice(array(bounds), block + 1, STEP))).cast("long")
    fine = max(1, min(MOST_BINS, n // BIN_DOCS + 1) // cells) if whole else 1
    if fine == 1:
        return F.when(at.isNull(), last).otherwise(cell * MOST_BINS)
    ends = [*bounds, ids[-1] + 1]
    lows, widths = [ids[0], *bounds], [max(1, -(-(b - a) // fine)) for a, b in zip([ids[0], *bounds], ends, strict=True)]
    inside = F.floor((at.cast("decimal(20,0)") - F.get(array(lows), cell).cast("decimal(20,0)")) / F.get(array(widths), cell))
    return F.when(at.isNull(), last).otherwise(cell * MOST_BINS + F.greatest(F.lit(0), F.least(F.lit(fine - 1), inside)).cast("long"))


def followed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs (doc_id, text, carry...) with next_text and next_<carry> of the next document by id, the first after the last.

    Ids of any type that has an order are cut into bins; a window sorts each bin, to which the first document of
    the bin after it is added.
    """
    at = _bin(docs)
    first = docs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    by_bin = Window.orderBy("bin")  # over at most MOST_BINS + MOST_CELLS rows
    before = F.coalesce(F.lag("bin").over(by_bin), F.max("bin").over(Window.partitionBy()))
    links = F.broadcast(first.select("id", F.col("bin").alias("own"), before.alias("before")))
    dealt = docs.withColumn("bin", at).alias("d").join(links.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.id")) & (F.col("d.bin") == F.col("l.own")), "left")
    places = F.filter(F.array(F.struct(F.col("bin"), F.lit(False).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bin"), F.lit(True).alias("guest")))), lambda x: x.isNotNull())
    rows = dealt.select("d.*", F.explode(places).alias("place")).select(*docs.columns, F.col("place.bin").alias("at_bin"), F.col("place.guest").alias("guest"))
    order = Window.partitionBy("at_bin").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    return rows.select(*docs.columns, "guest", *(F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *carry])).filter(~F.col("guest")).drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = docs.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", *hashes("canon", "h1", "h2"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Equal hashes are settled by the bytes.
    same = lambda one, two, other: F.when((F.col("h1") == F.col(one)) & (F.col("h2") == F.col(two)), (canonical(F.col("text")).cast("binary") == other.cast("binary")).cast("double")).otherwise(0.0)
    edited = followed(own, ["h1", "h2"]).select(
        "doc_id", "text", "h1", "h2", n.cast("long").alias("n_chars"), same("next_h1", "next_h2", canonical(F.col("next_text"))).alias("near_next"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited")
    )
    both = edited.withColumn("canon", canonical(F.col("edited"))).select("*", *hashes("canon", "e1", "e2"))
    hashed = written(both.select("doc_id", "h1", "h2", "e1", "e2", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), same("e1", "e2", F.col("canon")).alias("near_edited"), "near_next"), "fingerprints")
    buckets = written(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "fingerprint-buckets")
    odd = written(unequal_members(docs, buckets, hashed), "fingerprint-odd")
    whole = hashed.alias("a").join(bounded(odd).alias("o"), F.col("a.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("a.h1") == F.col("o.h1")) & (F.col("a.h2") == F.col("o.h2")), "left").select("a.*", "odd")
    return whole.select("doc_id", "n_chars", "edited_sha256", F.concat(printed("h1", "h2"), F.coalesce("odd", F.lit(""))).alias("fingerprint"), printed("e1", "e2").alias("edited_fingerprint"), "near_edited", "near_next")
