"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed byte trigrams (letters only, lower case, other ASCII as one
blank class), of unit length. Training clusters each language's sample by spherical k-means; a text
gets the language of the centroid with the largest cosine. A text whose cosine is below what nearly
all training texts of that centroid reach is marked rejected; it still carries its nearest language.

The sample is bounded: at most about `per_language` texts of each language and `total` texts in all,
drawn by a hash of the id, so that memory on the driver doesn't grow with the corpus.
Null texts and texts without a letter are `und` with score 0, as is everything if nothing can be
learned. Null ids are never learned from and not held out. Repeated rows are scored alike; of languages with
the same cosine the first by name wins; extra columns are ignored; texts of any length are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import texts_of
from .common import fold, small_batches

DIM = 2048
_CLASS = np.full(256, 0x20, np.uint32)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


class Centroids(NamedTuple):
    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def trigram_counts(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), DIM), np.float32)
    for row, ends, data in texts_of(pc.utf8_lower(column)):
        c = _CLASS[data]
        code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) if len(c) > 2 else c[:0]
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
        code[(c[:-2] == 0x20) & (c[1:-1] == 0x20)] = DIM - 1 if len(code) else 0
        begin = 0
        for i, end in enumerate(ends):
            if end - begin > 2:
                out[row + i] = np.bincount(code[begin : end - 2], minlength=DIM)
            begin = end
    out[:, DIM - 1] = 0
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and each row's nearest."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def train(rows: list[tuple[str, np.ndarray]], per_language: int = 4, keep: float = 0.995, slack: float = 0.05, seed: int = 11) -> Centroids | None:
    """Centroids from (language, counts) rows; `keep` of each centroid's texts, less `slack` of cosine, stay accepted."""
    if not rows:
        return None
    counts = np.stack([c for _, c in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weigh(counts, idf)
    names = sorted({n for n, _ in rows})
    owner, vectors, least = [], [], []
    label = np.array([names.index(n) for n, _ in rows])
    for k in range(len(names)):
        own = x[label == k]
        c, near = cluster(own, per_language, seed + k)
        for j in range(len(c)):
            cos = own[near == j] @ c[j]
            owner.append(k)
            vectors.append(c[j])
            least.append(np.quantile(cos, 1 - keep) - slack if len(cos) else 1.0)
    return Centroids(names, np.array(owner), np.stack(vectors).astype(np.float32), idf, np.array(least))


def fit(docs: DataFrame, per_language: int = 800, total: int = 8000, clusters: int = 4) -> Centroids | None:
    """Learns from rows with an id outside the held-out fold, a text and a language."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    have = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total).collect()}
    if not have:
        return None
    cap = max(1, min(per_language, total // len(have)))
    share = spark.createDataFrame([(k, int(1_000_000 * min(1.0, cap / n)) + 1) for k, n in have.items()], "lang string, part int")
    drawn = usable.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("part"))

    def count(batches):
        for b in batches:
            x = trigram_counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.astype(np.uint16 if r.max(initial=0) < 65536 else np.float32).astype(np.float32).tobytes() for r in x], pa.binary())], ["lang", "h", "counts"])

    counted = drawn.select("lang", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(count, "lang string, h long, counts binary")
    got = counted.orderBy("h", "lang", "counts").limit(2 * total).collect()
    return train(sorted(((r["lang"], np.frombuffer(r["counts"], np.float32)) for r in got), key=lambda r: (r[0], r[1].tobytes())), clusters)


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs."""
    small_batches(docs.sparkSession)

    def predict(batches):
        for b in batches:
            text = b.column("text")
            letters = pd.Series([x is not None and any(map(str.isalpha, x)) for x in text.to_pylist()], dtype=bool).to_numpy()
            if model is None or not len(text):
                name, score, far = np.full(len(text), "und", object), np.zeros(len(text)), np.ones(len(text), bool)
            else:
                cos = weigh(trigram_counts(text), model.idf) @ model.vectors.T
                best = cos.argmax(1)
                score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
                far = score < model.least[best]
                name = np.array(model.languages, object)[model.owner[best]]
            name = np.where(letters, name, "und")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(name, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)], ["doc_id", "held_out", "lang_pred", "score", "rejected"]
            )

    own = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
