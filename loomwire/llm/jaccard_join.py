"""Exact Jaccard join of documents' sets of word shingles, by pivots and triangle-inequality windows.

Sets live in the metric space of the Jaccard distance d = 1 - |A & B| / |A | B|; two documents link at
d <= r = 0.2. Exact copies are one point. The result is the components of all links.

1. Bound. Between unlike texts all distances are near 1, so that no choice of pivots parts a whole corpus. Linked
   sets lack at most floor(n/5) of each other's shingles, so they share one of their first floor(n/5) + 1 under
   any one order; the order has rare shingles first, by hash, those of more than `most` windows last. Points that
   share such a shingle are in the region of the pivot that its points agree on; all others are too far apart.
2. Pivots. Every point is compared with the pivot that its shared shingles allow to be the nearest, then with those of
   its other regions that are in other components, unless the shingles that both share prove them too far
   apart. What is within r is linked, so that a large group of near copies costs about one comparison each. A region
   whose members are then all in one component is done.
3. Voronoi regions. Members of open regions whose windows share too little with those of each other component there
   to be linked leave them. An open region of more than BLOCK members draws up to PICKS pivots of its own, each from another
   component where it can. About PART of its members are compared with them first; where those show that the pivots
   don't part the region, it is a leaf, else all members are compared with them. A member x belongs to the region of its nearest
   pivot and, by the triangle inequality, to that of every pivot p with d(x, p) <= d(x, nearest) + 2r: a
   linked y whose nearest pivot is p can't be further from x. What is 3r or more from every pivot is
   one region of its own, to which boundary members, 2r or more from every pivot, belong as well. Regions go on
   the same way while that parts them: while the squares of the new sizes sum up to half the old one's at most. So
   a dense group, however large, takes about PART times PICKS comparisons in this step.
4. Leaves. Pairs of small regions, and blocks of those that pivots can't part (dense groups), are compared if
   they are of different components and the triangle inequality |d(x, p) - d(y, p)| <= r, their sizes and
   their shared shingles allow a link. In blocks the largest component is compared with the others, not with itself.

Every step is exact: what isn't compared is linked already or proven apart. Rows of a region are dealt out over
tasks whatever its size; a shingle that is common only under the second order is found by a sample of documents,
which decides how its rows are dealt, never which links are found. Distances are computed from whole sets.
Two passes read all texts, others those of candidates. What the driver gets is bounded: at most `most_hot` shingles
and their pivots, twice.

Sets are 64-bit hashes of lower-cased (A-Z) words; sets with equal 64-bit digests count as equal.
Texts with fewer than five words are one shingle; null texts and those without words have size 0, link to
nothing and are their own component, as are rows of an empty table: none. Very long texts are read in pieces of
half a MB. Rows with a null id get no component and link to nothing. Repeated rows and rows with one id are each
returned; a component is named by its smallest id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomwire.operators.components import components

from .bytescan import doc_words, mix, shingles
from .common import any_names, bounded, forget, small_batches, written

R = 0.2
EPS = 1e-9
WORDS = 5
MOST, MOST_HOT = 64, 500_000
#: Copies of one set are left out of a task's later windows while it remembers this many sets.
SEEN = 500_000
#: Rows of ids that are broadcast at most.
MOST_SENT = 200_000
#: Members of a region that is compared by pairs, of one that isn't parted further and of a block of a dense one, and of a
#: part that meets pivots in one task and of a trial.
LEAF, BLOCK, PART = 64, 512, 256
#: How often regions are parted, and pivots of a region each time.
ROUNDS, PICKS = 4, 16
#: Regions of up to so many members are thinned by their windows before pivots part them; larger ones after that.
THINNED = 4096
#: One document of so many is in the sample that finds common shingles, and rows there that make one common.
SAMPLED, COMMON = 16, 8
#: Blocks of a region's largest component are numbered from here.
LARGEST = 1 << 40


def _sets(column: pa.Array):
    """(row, sorted distinct shingle hashes as int64) of each text."""
    for row, words in doc_words(column):
        yield row, np.unique(shingles(words, WORDS).view(np.int64))


def _digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = mix(s.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(s))
        return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def _points(docs: DataFrame) -> DataFrame:
    """doc_id, n, point and, for a point's first row with an id in a task, its window by hash alone."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            n, point, window = [], [], []
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for row, s in _sets(b.column(1)):
                p = _digest(s) if len(s) else None
                n.append(len(s))
                point.append(p)
                window.append(s[: len(s) // 5 + 1] if p is not None and named[row] and p not in seen else s[:0])
                if named[row]:
                    seen.add(p)
                if len(seen) > SEEN:
                    seen.clear()
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in window])]).astype(np.int32)
            keys = np.concatenate(window) if window else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(point, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], ["doc_id", "n", "point", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, point long, window array<long>")


def _look_up(keys: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of s are in the sorted keys, and where."""
    at = np.searchsorted(keys, s)
    return (keys[np.minimum(at, len(keys) - 1)] == s if len(keys) else np.zeros(len(s), bool)), at


def _memberships(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """shingle, point and, for hot and common shingles, the pivot: the windows under the order that has hot shingles last."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, common))

    def run(batches):
        (hot, hot_pivots), (common, common_pivots) = shared.value
        seen: set[int] = set()
        for b in batches:
            keys, points, pivots, known = [], [], [], []
            for _, s in _sets(b.column(1)):
                if not len(s) or (p := _digest(s)) in seen:
                    continue
                seen.add(p)
                if len(seen) > SEEN:
                    seen.clear()
                take = len(s) // 5 + 1
                is_hot, at = _look_up(hot, s)
                rare, last = s[~is_hot][:take], np.flatnonzero(is_hot)
                last = last[: take - len(rare)]
                is_common, place = _look_up(common, rare)
                keys += [rare, s[last]]
                points.append(np.full(len(rare) + len(last), p, np.int64))
                pivots += [np.where(is_common, common_pivots[np.minimum(place, len(common) - 1)], 0) if len(common) else np.zeros(len(rare), np.int64), hot_pivots[at[last]]]
                known += [is_common, np.ones(len(last), bool)]
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            k, p, q, has = flat(keys, np.int64), flat(points, np.int64), flat(pivots, np.int64), flat(known, bool)
            for i in range(0, max(1, len(k)), 200_000):
                j = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[j]), pa.array(p[j]), pa.array(q[j], mask=~has[j])], ["shingle", "point", "pivot"])

    return docs.mapInArrow(run, "shingle long, point long, pivot long")


def _pivots(rows: DataFrame, more_than: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of more rows than that, and the least point of each."""
    got = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("point").alias("pivot")).filter(F.col("n") > more_than).select("shingle", "pivot").toArrow()
    keys, pivots = (np.asarray(got.column(i).to_numpy(), np.int64) for i in range(2))
    order = np.argsort(keys)
    return keys[order], pivots[order]


def _regions(memberships: DataFrame) -> DataFrame:
    """Members of regions with two points or more, each with its region's pivot; where none is known, the least point."""
    spread = memberships.withColumn("deal", F.when(F.col("pivot").isNull(), F.col("shingle")).otherwise(F.xxhash64("shingle", "point")))
    n = int(memberships.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = spread.repartition(n, "deal").sortWithinPartitions("shingle", "point").select("shingle", "point", "pivot")
    names = ["shingle", "point", "pivot"]

    def run(batches):
        # Of the shingle at the end of a batch: its pivot, its last point, and whether the pivot's row still waits for a second point.
        key = pivot = last = None
        waits = False
        for b in batches:
            known = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            k, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if known.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(known)) for c in b.columns], names)
            k, p = k[~known], p[~known]
            if waits:
                k, p = np.append(np.int64(key), k), np.append(np.int64(pivot), p)
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
            goes_on = key is not None and not waits and int(k[0]) == key
            if goes_on:
                new[0] = int(p[0]) != last
            if not new.any():
                continue
            k, p = k[new], p[new]
            start = np.ones(len(k), bool)
            start[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(start)
            size = np.diff(np.append(first, len(k)))
            own = p[first].copy()
            more = size > 1
            if goes_on and int(k[0]) == key:
                own[0], more[0] = pivot, True
            take = np.repeat(more, size)
            key, pivot, last, waits = int(k[-1]), int(own[-1]), int(p[-1]), not more[-1]
            yield pa.RecordBatch.from_arrays([pa.array(k[take]), pa.array(p[take]), pa.array(np.repeat(own, size)[take])], names)

    return sorted_.mapInArrow(run, "shingle long, point long, pivot long")


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """point, n and set of the wanted (doc_id, point)."""

    def run(batches):
        for b in batches:
            points, sets = [], []
            want = b.column("point").to_pylist()
            for row, s in _sets(b.column("text")):
                if len(s) and _digest(s) == want[row]:
                    points.append(want[row])
                    sets.append(s)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["point", "n", "members"])

    return docs.join(wanted, "doc_id").select("text", "point").mapInArrow(run, "point long, n long, members array<long>")


def _beyond(n: Column) -> Column:
    """How many of a set's shingles are outside its window."""
    return n - F.floor(n / 5) - 1


def _bounds(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """x, y, lowest distance, possible: what the regions that both are in say of pairs (x, y), exactly.

    Of two sets one window ends first. Up to there all that both hold is among their common regions; beyond
    there only the rest of that set can be common.
    """
    a, b = (known.select(F.col("point").alias(k), F.col("n").alias(f"n{k}"), F.col("keys").alias(f"k{k}")) for k in "xy")
    shared = F.size(F.array_intersect("kx", "ky")).cast("long")
    most = F.least(shared + F.greatest(_beyond(F.col("nx")), _beyond(F.col("ny"))), "nx", "ny")
    both = pairs.join(a, "x").join(b, "y").select("x", "y", (F.col("nx") + F.col("ny")).alias("sum"), most.alias("most"))
    return both.select("x", "y", (1 - F.col("most") / (F.col("sum") - F.col("most"))).alias("low"), (F.col("most") * 9 >= F.col("sum") * 4).alias("possible"))


def _sets_of(points: DataFrame, docs: DataFrame, named: DataFrame, name: str) -> DataFrame:
    """point, n, members of the points."""
    ends = points.distinct().join(named, "point").select(F.col("first").alias("doc_id"), "point")
    return written(_candidate_sets(docs, bounded(written(ends, f"{name}-ends"), most=MOST_SENT)), f"{name}-sets")


def _distances(pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """x, y of the pairs (x, y) of points that are linked, by their whole sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("x", "y")).alias("point")), docs, named, "jaccard-leaf")
    a, b = (sets.select(F.col("point").alias(k), F.col("n").alias(f"n{k}"), F.col("members").alias(f"s{k}")) for k in "xy")
    both = F.size(F.array_intersect("sx", "sy")).cast("long")
    near = pairs.join(a, "x").join(b, "y").select("x", "y", both.alias("both"), (F.col("nx") + F.col("ny") - both).alias("all")).distinct()
    near = written(near.filter(F.col("both") * 100 >= F.col("all") * 80).select("x", "y"), "jaccard-leaf")
    forget(sets)
    return near


def _against(members: DataFrame, picks: DataFrame, docs: DataFrame, named: DataFrame, name: str) -> DataFrame:
    """region, point, pick, distance, linked of every member (region, point) and every pick (region, point) of its region.

    Members of large regions are dealt into parts, to each of which the region's picks are sent; members meet them
    one by one, as they come.
    """
    sets = _sets_of(members.select("point").unionByName(picks.select("point")), docs, named, name)
    large = members.groupBy("region").agg(F.count("*").alias("of")).filter(F.col("of") > PART).select("region", (F.floor(F.col("of") / PART) + 1).alias("parts"))
    large = bounded(written(large, f"{name}-large"))
    dealt = members.join(large, "region", "left").select("region", F.coalesce(F.pmod(F.xxhash64("point"), F.col("parts")), F.lit(0)).alias("part"), F.lit(1).alias("kind"), "point")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    sent = picks.join(large, "region", "left").select("region", everywhere.alias("part"), F.lit(0).alias("kind"), "point")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.unionByName(sent).join(sets.select("point", "members"), "point").select("region", "part", "kind", "point", "members")

    def run(batches):
        at, chosen = None, []
        for b in batches:
            region, part, kind, point = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            offsets, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy(zero_copy_only=False)
            out = []
            for i in range(b.num_rows):
                s = flat[offsets[i] : offsets[i + 1]]
                if (region[i], part[i]) != at:
                    at, chosen = (region[i], part[i]), []
                if kind[i] == 0:
                    chosen.append((point[i], s.copy()))
                    continue
                for p, t in chosen:
                    if p != point[i]:
                        both = int(_look_up(t, s)[0].sum())
                        out.append((region[i], point[i], p, both, len(s) + len(t) - both))
            region_, point_, pick_, both_, all_ = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(region_), pa.array(point_), pa.array(pick_), pa.array(1 - both_ / np.maximum(all_, 1)), pa.array(both_ * 100 >= all_ * 80)], ["region", "point", "pick", "distance", "linked"])

    met = rows.repartition(n, "region", "part").sortWithinPartitions("region", "part", "kind").mapInArrow(run, "region long, point long, pick long, distance double, linked boolean")
    met = written(met, name)
    forget(sets)
    return met


def _picks(members: DataFrame) -> DataFrame:
    """region, point: up to PICKS members of each region, from different components where there are as many."""
    slot = F.pmod(F.xxhash64("part", "region"), F.lit(PICKS))
    return members.groupBy("region", slot.alias("slot")).agg(F.min_by("point", F.xxhash64("point", "region")).alias("point")).select("region", "point")


def _cells(met: DataFrame, picks: DataFrame) -> DataFrame:
    """region, cell, point, low, high: the Voronoi regions of the picks with their windows, without the picks, which are settled."""
    each = met.groupBy("region", "point").agg(F.min("distance").alias("own"), F.collect_list(F.struct("pick", "distance")).alias("all"))
    each = each.join(picks, ["region", "point"], "left_anti")
    near = F.transform(F.filter("all", lambda p: (F.col("own") < 3 * R) & (p["distance"] <= F.col("own") + 2 * R + EPS)), lambda p: F.struct(p["pick"].alias("pick"), p["distance"].alias("low"), p["distance"].alias("high")))
    far = F.when(F.col("own") >= 2 * R - EPS, F.array(F.struct(F.lit(None).cast("long").alias("pick"), F.col("own").alias("low"), F.lit(1.0).alias("high")))).otherwise(F.array())
    placed = each.select("region", "point", F.explode(F.concat(near, far)).alias("at"))
    return placed.select("region", F.xxhash64("region", "at.pick", F.col("at.pick").isNull()).alias("cell"), "point", "at.low", "at.high")


def _parted(sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """region: those of sizes (region, of) that their cells part."""
    squares = cells.groupBy("region", "cell").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    return written(sizes.join(squares, "region", "left").filter(F.coalesce("squares", F.lit(0.0)) * 2 <= F.col("of").cast("double") * F.col("of")).select("region"), "jaccard-parted")


def _met(members: DataFrame, picks: DataFrame, docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What _against gives for members (region, point, of) and picks, and region: those that the picks may part.

    Of the others only a trial of about PART members has met the picks.
    """
    members = members.withColumn("tried", F.pmod(F.xxhash64("region", "point"), F.col("of")) < PART)
    trial, rest = members.filter("tried").select("region", "point"), members.filter(~F.col("tried")).select("region", "point")
    met = _against(trial, picks, docs, named, "jaccard-trial")
    hopeful = _parted(trial.groupBy("region").agg(F.count("*").alias("of")), _cells(met, picks))
    rest = written(rest.join(bounded(hopeful), "region", "left_semi"), "jaccard-rest")
    if not rest.isEmpty():
        met = met.unionByName(_against(rest, picks.join(bounded(hopeful), "region", "left_semi"), docs, named, "jaccard-met"))
    return met, hopeful


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links (x, y) a forest needs that joins what all of them join."""
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root.setdefault(up, up)
        return k

    kept = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            kept.append(i)
    return np.array(kept, np.int64)


def _intersections(lists: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the lists of rows a share with those of rows b: a product of incidence matrices, by slices of columns."""
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # columns that one row alone has don't matter
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    both = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        x, y = np.searchsorted(column, (first, first + 2048))
        m = np.zeros((len(size), 2048), np.float32)
        m[row[x:y], column[x:y] - first] = 1
        both += m[a] @ m[b].T
    return both


def _plausible(members: DataFrame, known: DataFrame) -> DataFrame:
    """region, point: the members that the bound of _bounds lets be linked with one of another component in their region.

    members: region, point, part, of. Only the shingles of windows that several points have are sent, a fifth of a set at
    most, and what comes back is members, not pairs.
    """
    blocks = F.floor((F.col("of") - 1) / BLOCK) + 1
    placed = known.join(bounded(members.select("region", "point", "part", blocks.alias("blocks"))), "point").withColumn("block", F.pmod(F.xxhash64("point"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "point", "part", "n", "keys")

    def run(t: pa.Table) -> pa.Table:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        block, point, part, n = (t.column(c).to_numpy() for c in ("block", "point", "part", "n"))
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        beyond = n - n // 5 - 1
        most = _intersections(t.column("keys").combine_chunks(), a, b) + np.maximum(beyond[a][:, None], beyond[b][None])
        most = np.minimum(most, np.minimum(n[a][:, None], n[b][None]))
        may = (most * 9 >= (n[a][:, None] + n[b][None]) * 4) & (part[a][:, None] != part[b][None])
        stay = np.unique(point[np.concatenate([a[may.any(1)], b[may.any(0)]])])
        return pa.table({"region": pa.array(np.full(len(stay), t.column("region")[0].as_py(), np.int64)), "point": pa.array(stay)})

    return written(dealt.groupBy("region", "low", "high").applyInArrow(run, "region long, point long").distinct(), "jaccard-plausible")


def _block_links(members: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Links (x, y) between components of dense regions: of two blocks, as few as join their components.

    members: region, point, part, low, high. A region's largest component and all its others are dealt into blocks of
    their own; two blocks of others, or one of others and one of the largest, are one group, whose intersections
    are a product of incidence matrices. Members of the largest that are too far from or too near to the
    region's pivot for any of the others are left out.
    """
    counts = members.groupBy("region", "part").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    largest = written(counts.groupBy("region").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("of")), "jaccard-largest")
    others = members.join(bounded(largest.select("region", "main")), "region").filter("part <> main").groupBy("region").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    known = bounded(written(largest.join(others, "region"), "jaccard-dense"))
    main = F.col("part") == F.col("main")
    placed = members.join(known, "region").filter(~main | ((F.col("low") <= F.col("to") + R + EPS) & (F.col("high") >= F.col("from") - R - EPS)))
    n_others, n_main = F.floor((F.col("of") - F.col("n_main")) / BLOCK) + 1, F.floor(F.col("n_main") / BLOCK) + 1
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    placed = placed.withColumn("block", F.when(main, F.pmod(F.xxhash64("point"), n_main) + LARGEST).otherwise(F.pmod(F.xxhash64("point"), n_others)))
    placed = placed.withColumn("other", F.explode(F.when(main, numbers(n_others)).otherwise(F.concat(numbers(n_others), F.transform(numbers(n_main), lambda k: k + LARGEST)))))
    dealt = placed.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "point", "part")
    sets = _sets_of(members.select("point"), docs, named, "jaccard-block")

    def links(t: pa.Table) -> pa.Table:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        block, point, part = (t.column(c).to_numpy() for c in ("block", "point", "part"))
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        lists = t.column("members").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        both = _intersections(lists, a, b)
        every = size[a][:, None] + size[b][None] - both
        i, j = np.nonzero((both * 100 >= every * 80) & (part[a][:, None] != part[b][None]))
        x, y = a[i], b[j]
        _, one = np.unique(np.stack([np.minimum(part[x], part[y]), np.maximum(part[x], part[y])]), axis=1, return_index=True)
        one = one[_forest(part[x[one]], part[y[one]])]
        return pa.table({"x": point[x[one]], "y": point[y[one]]}, schema=pa.schema([("x", pa.int64()), ("y", pa.int64())]))

    return dealt.join(sets.select("point", "members"), "point").groupBy("region", "low", "high").applyInArrow(links, "x long, y long")


def _apart(a: str, b: str) -> Column:
    """Members a and b of one region that are in different components and that nothing known so far keeps from being linked."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (
        (c(a, "part") != c(b, "part"))
        & (c(a, "low") - c(b, "high") <= R + EPS)
        & (c(b, "low") - c(a, "high") <= R + EPS)
        & (c(a, "n") * 5 >= c(b, "n") * 4)
        & (c(b, "n") * 5 >= c(a, "n") * 4)
        # They have no more regions in common than the one with fewer is in.
        & ((F.least(c(a, "k"), c(b, "k")) + F.greatest(_beyond(c(a, "n")), _beyond(c(b, "n")))) * 9 >= (c(a, "n") + c(b, "n")) * 4)
    )


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, part after more links (x, y)."""
    side = lambda k: found.select(F.col("node").alias(k), F.col("part").alias(f"p{k}"))
    ends = written(links.join(side("x"), "x", "left").join(side("y"), "y", "left").select("x", "y", F.coalesce("px", "x").alias("px"), F.coalesce("py", "y").alias("py")), "jaccard-ends")
    joined = components(ends.select(F.col("px").alias("x"), F.col("py").alias("y")))
    every = found.unionByName(ends.select(F.col("x").alias("node"), F.col("px").alias("part"))).unionByName(ends.select(F.col("y").alias("node"), F.col("py").alias("part"))).distinct()
    return written(every.join(joined.select(F.col("node").alias("part"), F.col("part").alias("to")), "part", "left").select("node", F.coalesce("to", "part").alias("part")), "jaccard-parts")


def _joined(docs: DataFrame, most: int = MOST, most_hot: int = MOST_HOT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, point of every row of docs (doc_id, text); and point, first, part, low of every point: its smallest id, its component and the smallest id there."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    points = written(_points(docs), "jaccard-points")
    total = points.agg(F.sum(F.size("window"))).first()[0] or 0
    most = max(most, -(-total // most_hot))
    hot = _pivots(points.select(F.explode("window").alias("shingle"), "point"), most)
    ids = written(points.select("doc_id", F.col("n").alias("n_shingles"), "point"), "jaccard-ids")
    forget(points)
    named = written(ids.filter(F.col("doc_id").isNotNull() & F.col("point").isNotNull()).groupBy("point").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n")), "jaccard-named")

    # 1. Regions by shared shingles.
    usable = docs.filter(F.col("doc_id").isNotNull())
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    common = _pivots(_memberships(sample, hot, none).filter("pivot is null"), max(COMMON, most // SAMPLED))
    regions = written(_regions(_memberships(usable, hot, common)), "jaccard-regions")
    # The pivot of a hot shingle may itself be in no region: then it has no keys, but is compared all the same.
    pivot = regions.select(F.lit(None).cast("long").alias("shingle"), F.col("pivot").alias("point")).distinct()
    known = written(regions.select("shingle", "point").unionByName(pivot).groupBy("point").agg(F.collect_set("shingle").alias("keys")).join(named.select("point", "n"), "point"), "jaccard-known")

    # 2. Every member against its region's pivot.
    stars = regions.filter(F.col("point") != F.col("pivot")).select(F.col("point").alias("x"), F.col("pivot").alias("y")).distinct()
    stars = written(_bounds(stars, known), "jaccard-stars")
    # First the pivot that may be nearest, then those of other components.
    possible = stars.filter("possible").select(F.col("x").alias("point"), F.col("y").alias("region"), "low")
    first = written(possible.groupBy("point").agg(F.min_by("region", F.struct("low", "region")).alias("region")), "jaccard-first")
    star = lambda members: _against(members, members.select("region", F.col("region").alias("point")).distinct(), docs, named, "jaccard-near")
    linked = lambda met: met.filter("linked").select(F.col("point").alias("x"), F.col("pick").alias("y"))
    near = star(first)
    found = written(components(linked(near)), "jaccard-parts")
    part_of = lambda k: found.select(F.col("node").alias(k), F.col("part").alias(f"_{k}"))
    apart = possible.select("point", "region").join(first, ["point", "region"], "left_anti").join(part_of("point"), "point", "left").join(part_of("region"), "region", "left")
    apart = written(apart.filter(F.coalesce("_point", "point") != F.coalesce("_region", "region")).select("point", "region"), "jaccard-apart")
    if not apart.isEmpty():
        more = star(apart)
        near = near.unionByName(more)
        found = _merged(found, linked(more))
    spans = stars.select("x", "y", F.col("low").alias("least")).join(near.select(F.col("point").alias("x"), F.col("pick").alias("y"), "distance"), ["x", "y"], "left")
    spans = spans.select(F.col("x").alias("point"), F.col("y").alias("pivot"), F.coalesce("distance", "least").alias("low"), F.coalesce("distance", F.lit(1.0)).alias("high"))

    # Regions that are still in several components. Pivots are compared with all members, so only the others can be unsettled.
    part = regions.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("part", F.coalesce("part", "point"))
    open_ = part.filter(F.col("point") != F.col("pivot")).groupBy("shingle", "pivot").agg(F.min("part").alias("least"), F.max("part").alias("last")).filter("least <> last").select("shingle", "pivot")
    going = part.join(bounded(written(open_, "jaccard-unsettled"), most=MOST_SENT), ["shingle", "pivot"]).select("pivot", "point").distinct()
    members = written(going.join(spans, ["point", "pivot"]).select(F.col("pivot").alias("region"), "point", "low", "high"), "jaccard-open")
    placed = lambda m, parts: m.join(parts.withColumnRenamed("node", "point"), "point", "left").withColumn("part", F.coalesce("part", "point"))

    def still_open(m: DataFrame, parts: DataFrame) -> DataFrame:
        """region, of: the regions with several components and their sizes."""
        sizes = placed(m, parts).groupBy("region").agg(F.count("*").alias("of"), F.min("part").alias("least"), F.max("part").alias("last"))
        return written(sizes.filter("least <> last").select("region", "of"), "jaccard-several")

    def thinned(m: DataFrame, parts: DataFrame, most: int | None = None) -> DataFrame:
        """m without those members of large regions that their windows prove unlinked with all other components there."""
        large = still_open(m, parts).filter(F.col("of") > LEAF)
        large = large if most is None else large.filter(F.col("of") <= most)
        if large.isEmpty():
            return m
        stay = _plausible(written(placed(m, parts).join(bounded(large), "region").select("region", "point", "part", "of"), "jaccard-thick"), known)
        return written(m.join(bounded(large), "region", "left_anti").unionByName(m.join(bounded(stay), ["region", "point"], "left_semi").select(*m.columns)), "jaccard-thin")

    # 3. Large regions are parted by pivots of their own.
    leaves = []
    members = thinned(members, found, THINNED)
    for _ in range(ROUNDS):
        several = still_open(members, found)
        large = several.filter(F.col("of") > BLOCK)
        if large.isEmpty():
            break
        leaves.append(members.join(bounded(several.filter(F.col("of") <= BLOCK).select("region")), "region", "left_semi"))
        members = written(members.join(bounded(large), "region"), "jaccard-large")
        picks = written(_picks(placed(members, found)), "jaccard-picks")
        met, hopeful = _met(members, picks, docs, named)
        more = written(linked(met), "jaccard-more")
        found = found if more.isEmpty() else _merged(found, more)
        cells = written(_cells(met.join(bounded(hopeful), "region", "left_semi"), picks), "jaccard-cells")
        parted = _parted(large.join(bounded(hopeful), "region", "left_semi"), cells)
        leaves.append(members.drop("of").join(bounded(parted), "region", "left_anti"))
        members = written(cells.join(bounded(parted), "region", "left_semi").select(F.col("cell").alias("region"), "point", "low", "high"), "jaccard-open")
    for leaf in leaves:
        members = members.unionByName(leaf.select(*members.columns))

    # 4. What is left of small regions is compared pair by pair, of dense ones block by block.
    members = thinned(members, found)
    several = still_open(members, found)
    left = placed(members.join(bounded(several, most=MOST_SENT), "region"), found).join(known.select("point", "n", F.size("keys").alias("k")), "point")
    left = written(left, "jaccard-left")
    few, many = left.filter(F.col("of") <= LEAF), left.filter(F.col("of") > LEAF)
    rest = few.alias("a").join(few.alias("b"), (F.col("a.region") == F.col("b.region")) & (F.col("a.point") < F.col("b.point")) & _apart("a", "b")).select(F.col("a.point").alias("x"), F.col("b.point").alias("y")).distinct()
    ends = bounded(few.select("point").distinct(), most=MOST_SENT)
    rest = written(_bounds(rest, known.join(ends, "point", "left_semi")).filter("possible").select("x", "y"), "jaccard-rest")
    more = rest if rest.isEmpty() else _distances(rest, docs, named)
    if not many.isEmpty():
        more = more.unionByName(_block_links(many.select("region", "point", "part", "low", "high"), docs, named))
    more = written(more, "jaccard-more")
    final = found if more.isEmpty() else _merged(found, more)
    # A component's name: the smallest id of its points.
    by_point = named.select("point", "first").join(bounded(final.withColumnRenamed("node", "point"), most=MOST_SENT), "point", "left").withColumn("part", F.coalesce("part", "point"))
    low = by_point.groupBy("part").agg(F.min("first").alias("low"))
    return ids, written(by_point.join(low, "part").select("point", "first", "part", "low"), "jaccard-names")


def join(docs: DataFrame, most: int = MOST, most_hot: int = MOST_HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    ids, names = _joined(docs, most, most_hot)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return ids.join(names.select("point", "low"), "point", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def _with_point(docs: DataFrame, name: str) -> DataFrame:
    """docs with the digest of each text's set in a column of that name."""

    def run(batches):
        for b in batches:
            points = [None] * b.num_rows
            for row, s in _sets(b.column("text")):
                points[row] = _digest(s) if len(s) else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(points, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


@any_names("doc_id", "text")
def one_each(docs: DataFrame) -> DataFrame:
    """Of each component one row, of the document that names it; rows without an id and those without words stay.

    Texts that share an id are judged each by itself: unlike ones stay, of equal sets the first by text stays.
    """
    ids, names = _joined(docs)
    chosen = names.filter(F.col("first") == F.col("low")).groupBy("part").agg(F.min("point").alias("point"), F.min("low").alias("doc_id")).select("doc_id", "point")
    wordless = ids.filter(F.col("doc_id").isNotNull() & F.col("point").isNull()).select("doc_id", "point").distinct()
    kept = written(chosen.unionByName(wordless), "jaccard-kept")
    twice = written(ids.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "jaccard-twice")
    stay = docs.join(bounded(kept.select("doc_id").distinct()), "doc_id", "left_semi").select(*docs.columns)
    if not twice.isEmpty():
        point = "_point"
        while point in docs.columns:
            point += "_"
        again = _with_point(stay.join(bounded(twice), "doc_id", "left_semi").select(*docs.columns), point).alias("d")
        same = (F.col("d.doc_id") == F.col("k.doc_id")) & F.col(f"d.{point}").eqNullSafe(F.col("k.point"))
        again = again.join(kept.alias("k"), same, "left_semi").groupBy("doc_id", point).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce("text", F.lit(""))).alias("row"))
        stay = stay.join(bounded(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*"))
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, generate_series(1, greatest(len(w) - 4, 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
