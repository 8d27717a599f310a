"""Vector codes by product quantisation with integer codebooks, assigned by partial-distance search.

Components become integers, vectors are cut into consecutive parts, and each part position has a codebook that some
rounds of assignment and floor means refine. The search takes the dimensions of a part in descending variance of the
codebook: after the first of them each vector completes the distance to its most promising entry, then masks drop all
(vector, entry) pairs whose integer distance so far strictly exceeds the best complete one, so that no nearest entry and
no tie is lost. Ties go to the lower index.

A round is one pass over the vectors: tasks assign their own and add up what belongs to each entry, Spark adds the tasks'
sums, and the driver gets one row for each component of the codebooks (entries times dimension, whatever the number of vectors). Sums
are exact: long limbs of 40 bits, and Python integers where components pass LARGEST.

Dropped: vectors that are null, or hold null or non-finite components, or have another length than the vector with the
smallest id (they have no distance to it). A dimension that the parts don't divide gives the first parts one more. Null ids
count as the largest. Of equal ids the smaller vectors come first. With fewer vectors than entries the codebooks are as
small. Equal rows have equal codes. An empty table gives no rows. Extra columns are ignored. Errors beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components up to this are added and squared in 64 bits: 2**52 a square, 2**11 dimensions.
LARGEST = 1 << 25
#: Vectors searched at a time, and dimensions that all entries get before pairs are dropped.
BLOCK, FIRST = 1024, 4
LIMB, LIMBS = 40, 4
MOST_ERROR = (1 << 63) - 1


class Part(NamedTuple):
    """One position's codebook with the dimensions in the order of the search."""

    entries: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Part:
        x = entries.astype(float)
        return cls(entries, np.argsort(-x.var(axis=0), kind="stable"))


def nearest(x: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of x, and its squared distance."""
    wide = np.int64 if x.dtype != object and part.entries.dtype != object else object
    index, error = np.empty(len(x), np.int64), np.empty(len(x), wide)
    book = np.ascontiguousarray(part.entries[:, part.order]).astype(wide)
    for a in range(0, len(x), BLOCK):
        rows = x[a : a + BLOCK][:, part.order].astype(wide)
        index[a : a + BLOCK], error[a : a + BLOCK] = _search(rows, book)
    return index, error


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    so_far = np.zeros((len(x), len(book)), x.dtype)
    for d in range(min(FIRST, x.shape[1])):
        so_far += (x[:, d, None] - book[None, :, d]) ** 2
    likely = so_far.argmin(axis=1)
    best = ((x - book[likely]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])  # by row, then entry
    at = so_far[row, entry]
    for d in range(FIRST, x.shape[1]):
        at = at + (x[row, d] - book[entry, d]) ** 2
        keep = at <= best[row]
        row, entry, at = row[keep], entry[keep], at[keep]
    starts = np.searchsorted(row, np.arange(len(x)))  # each row keeps its nearest entry at least
    least = np.minimum.reduceat(at, starts)
    tied = np.flatnonzero(at == least[row])
    return entry[tied[np.unique(row[tied], return_index=True)[1]]], least


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column whose rows all have `width` components; of Python integers if one passes LARGEST."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * SCALE).reshape(len(column), width)
    if x.size and np.abs(x).max() > LARGEST:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(np.int64)


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Ends of the parts; the first width % parts of them have one dimension more."""
    at, out = 0, []
    for k in range(parts):
        to = at + width // parts + (k < width % parts)
        out.append((at, to))
        at = to
    return out


class Codebooks(NamedTuple):
    parts: list[Part]
    width: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for p in self.parts for v in p.entries.ravel()).encode()).hexdigest()


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, embedding and label of the rows whose vectors have finite components only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label")).filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))


def _sums(kept: DataFrame, books: Codebooks, n_parts: int) -> DataFrame:
    """part, entry, position -> n and the exact sum, in limbs, of the parts that each entry is nearest to."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        b = shared.value
        total = [np.zeros(p.entries.shape, object) for p in b.parts]
        count = [np.zeros(len(p.entries), np.int64) for p in b.parts]
        for batch in batches:
            x = integers(batch.column(0), b.width)
            for k, (lo, hi) in enumerate(cuts(b.width, n_parts)):
                near, _ = nearest(x[:, lo:hi], b.parts[k])
                part = np.zeros(b.parts[k].entries.shape, x.dtype)
                np.add.at(part, near, x[:, lo:hi])
                total[k] += part
                count[k] += np.bincount(near, minlength=len(count[k]))
        rows = [(k, e, d, int(count[k][e]), int(total[k][e, d])) for k in range(len(total)) for e in np.flatnonzero(count[k]) for d in range(total[k].shape[1])]
        limbs = [[(s >> LIMB * i) & ((1 << LIMB) - 1) if i < LIMBS - 1 else s >> LIMB * i for *_, s in rows] for i in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], *limbs)], ["part", "entry", "position", "n", *(f"s{i}" for i in range(LIMBS))])

    schema = "part long, entry long, position long, n long, " + ", ".join(f"s{i} long" for i in range(LIMBS))
    return kept.select("embedding").mapInArrow(add, schema).groupBy("part", "entry", "position").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(LIMBS)))))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the usable vectors; None without any."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).select(F.size("embedding")).collect()
    if not first:
        return None
    width = first[0][0]
    same = kept.filter(F.size("embedding") == width)
    seed = same.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()["embedding"].combine_chunks()
    x = integers(seed, width)
    books = Codebooks([Part.of(x[:, lo:hi]) for lo, hi in cuts(width, parts)], width)
    for _ in range(rounds):
        new = [p.entries.astype(object) for p in books.parts]
        for r in _sums(same, books, parts).collect():
            new[r.part][r.entry, r.position] = sum(r[f"s{i}"] << LIMB * i for i in range(LIMBS)) // r.n
        small = all(abs(int(v)) <= LARGEST for p in new for v in p.ravel())
        books = Codebooks([Part.of(p.astype(np.int64) if small else p) for p in new], width)
    return books


def encode(kept: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of every vector of the codebooks' width."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        b = shared.value
        for batch in batches:
            x = integers(batch.column(1), b.width)
            found = [nearest(x[:, lo:hi], b.parts[k]) for k, (lo, hi) in enumerate(cuts(b.width, parts))]
            code = ["".join(f"{i:02x}" for i in each) for each in zip(*(i.tolist() for i, _ in found), strict=True)]
            error = [e if e <= MOST_ERROR else None for e in (sum(each) for each in zip(*(e.tolist() for _, e in found), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return kept.filter(F.size("embedding") == books.width).select("vec_id", "embedding", "label").mapInArrow(assign, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels added up, nulls together) and codebooks_sha256."""
    kept = usable(vectors)
    books = fit(kept, parts, entries, rounds)
    if books is None:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = encode(kept, books, parts)
    by_label = bounded(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("_label"), F.expr("try_cast(sum as bigint)").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for compress() where the parts divide the dimension and ids differ."""
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, x[p * w + 1 : (p + 1) * w] AS v FROM kept, range({parts}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {entries}
)"""
    distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        out += f""", near{k} AS MATERIALIZED (
  SELECT a.vec_id, a.p, any_value(a.v) AS v, min(struct_pack(d := {distance}::BIGINT, e := b.e)) AS m FROM parts a JOIN book{k} b USING (p) GROUP BY a.vec_id, a.p
)"""
        if k < rounds:
            out += f""", mean{k} AS (
  SELECT p, e, list(c ORDER BY i) AS v FROM (
    SELECT p, m.e AS e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS c FROM near{k}, range(1, (SELECT any_value(w) FROM kept) + 1) t(i) GROUP BY p, m.e, i
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)"""
    return out + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id)
"""
