"""Document quality by Bradley-Terry ranking.

Each document has a strength, linear in features of its whole text. Preference pairs set a document
labelled good over one labelled bad; weights minimise the logistic loss of the pairs' feature
differences. Documents are accepted from a quantile of the strengths on: the quantile with the fewest
errors on the labelled sample, the lowest of equals. The score is the logistic function of the
distance to that threshold, so 0.5 is the threshold itself.

The model is fitted on a bounded sample, `sample` labelled rows by a hash of the id and `pairs` pairs;
scoring reads all documents whole, in one pass without a shuffle.
Null texts count as empty and are scored. Rows with a null label or id are not learned from; with
several labels for one id each counts. Without both labels every score is 0.5. Repeated rows and equal texts score
alike, ties of strength at the threshold are accepted, very long texts are read in pieces of half a MB, and an
empty table gives no rows. `score` replaces columns of its own names; `accepted` keeps all columns as they are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import BLANK, mix, texts_of, words_of
from .common import any_names, fold, plain_names, small_batches

PUNCTUATION = b"!|*$%&#.,?:;\"'()/\\<>{}[]=+-_@~^`"
N_FEATURES = len(PUNCTUATION) + 15


class Ranking(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    spread: float


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: shares of kinds of characters, lengths, repetition of words, word pairs and lines."""
    out = np.zeros((len(column), N_FEATURES))
    for row, ends, data in texts_of(column):
        starts, hashes = words_of(data)
        cuts = np.searchsorted(starts, ends)
        begin = word = 0
        for i, (end, cut) in enumerate(zip(ends, cuts, strict=True)):
            b, h = data[begin : end - 1], hashes[word:cut]
            begin, word = end, cut
            out[row + i] = _of_one(b, h)
    return out


def _of_one(b: np.ndarray, h: np.ndarray) -> np.ndarray:
    size, words = max(1, len(b)), max(1, len(h))
    count = np.bincount(b, minlength=256)
    share = count / size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    letters = max(1, count[65:91].sum() + count[97:123].sum() + count[128:].sum())
    lines = bytes(b).split(b"\n")
    pairs = mix(h[:-1]) ^ h[1:]
    return np.concatenate(
        [
            np.sqrt(count[list(PUNCTUATION)] / words),
            [
                np.log1p(len(b)),
                np.log1p(len(h)),
                np.log1p(size / words),
                count[65:91].sum() / letters,
                count[48:58].sum() / size,
                count[128:].sum() / size,
                count[BLANK].sum() / size,
                count[:32].sum() / size,
                len(set(lines)) / len(lines),
                np.log1p(len(lines) / words),
                len(np.unique(h)) / words,
                len(np.unique(pairs)) / max(1, len(pairs)),
                entropy,
                np.sqrt(share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()),
                float(len(h) < 5),
            ],
        ]
    )


def rank(x: np.ndarray, good: np.ndarray, pairs: int = 200_000, l2: float = 1e-3, seed: int = 5) -> Ranking | None:
    """Newton's method on the pairwise logistic loss."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        slope = -(d * p[:, None]).mean(0) + l2 * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(down) - np.concatenate([[0], np.cumsum(~y)]))  # if the first k are rejected
    possible = np.concatenate([[True], s[1:] > s[:-1], [True]])
    k = int(np.where(possible, wrong, len(s) + 1).argmin())
    t = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return Ranking(mean, scale, w, float(t), float(max(strength.std(), 1e-6)))


def strengths(x: np.ndarray, model: Ranking) -> np.ndarray:
    return np.clip((x - model.mean) / model.scale, -8, 8) @ model.weight


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Ranking | None:
    """Learns from labelled rows outside the held-out fold, at most about `sample` of them."""
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & (fold("doc_id", 3) != 1))
    have = usable.count()
    part = int(1_000_000 * min(1.0, sample / max(1, have))) + 1
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).orderBy(F.xxhash64("doc_id"), "quality").limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", (F.col("quality") > 0).alias("good"))

    def describe(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "good", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    described = rows.mapInArrow(describe, f"doc_id {kind}, good boolean, x binary")
    got = described.orderBy(F.xxhash64("doc_id"), "doc_id", "good", "x").limit(4 * sample).collect()
    if not got:
        return None
    return rank(np.stack([np.frombuffer(r["x"]) for r in got]), np.array([r["good"] for r in got]))


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """All columns of docs, then held_out, score and predicted (columns of docs with these names are replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    docs = plain_names(docs, "doc_id", "text")

    def judge(batches):
        for b in batches:
            n = b.num_rows
            d = (strengths(features(b.column("text")), model) - model.threshold) / model.spread if model and n else np.zeros(n)
            p = 1 / (1 + np.exp(-np.clip(4 * d, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    own = docs.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(judge, f"{schema}, score double, predicted int").toDF(*names, "held_out", "score", "predicted")


@any_names("doc_id", "text")
def accepted(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """The rows of docs that the model accepts, all of them without a model, with their own columns as they are."""
    small_batches(docs.sparkSession)

    def keep(batches):
        for b in batches:
            good = strengths(features(b.column("text")), model) >= model.threshold if model and b.num_rows else np.ones(b.num_rows, bool)
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
