"""Nearest neighbours by cosine, blockwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block; a pair of blocks is one dense product in one task.
BLOCK = 2048


def cosine_top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, least: float = 0.45, block: int = BLOCK) -> DataFrame:
    """(key, other, similarity, nth): each vector's k nearest others of at least `least`.

    Exact. Vectors are hashed into blocks; every unordered pair of blocks is one group of at most two blocks of rows,
    whose product gives each row's k best there; a second ranking keeps the k best of all. No pairs of rows are
    made outside numpy.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    kind = vectors.schema[key].dataType.simpleString()
    own = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("v").isNotNull()).withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    others = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")
    dealt = own.withColumn("o", F.explode(others)).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "key", "v")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"]).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        ids, side = pdf["key"].to_numpy(), pdf["b"].to_numpy()
        out = []
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        for mine, other in {(p, q), (q, p)}:
            a, b = np.flatnonzero(side == mine), np.flatnonzero(side == other)
            if not len(a) or not len(b):
                continue
            s = x[a] @ x[b].T
            s[ids[a][:, None] == ids[b][None]] = -2
            keep = min(k, s.shape[1])
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            out.append(pd.DataFrame({"key": np.repeat(ids[a], keep), "other": ids[b][top].ravel(), "similarity": np.take_along_axis(s, top, 1).ravel()}))
        got = pd.concat(out) if out else pd.DataFrame({"key": ids[:0], "other": ids[:0], "similarity": np.zeros(0)})
        return got[got["similarity"] >= least]

    near = dealt.groupBy("p", "q").applyInPandas(best, f"key {kind}, other {kind}, similarity double")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= k).withColumnRenamed("key", key)


def reuse(current: DataFrame, cached: DataFrame) -> DataFrame:
    """current (id, text_hash) with reused: the cache has the same text of that id."""
    return current.join(cached.select("id", F.col("text_hash").alias("_h")), "id", "left").withColumn("reused", F.coalesce(F.col("_h") == F.col("text_hash"), F.lit(False))).drop("_h")
