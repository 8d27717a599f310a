"""Connected components of links, by alternating large and small stars.

Each round hooks every node's larger neighbours to the least node of its neighbourhood, then its smaller
ones; edges stay as few as they were and the number of rounds is logarithmic in practice. Every round
is written to the shared folder, so lost executors cost one round at most. Nodes with many neighbours are
never gathered: their least neighbour is sent to the edges, which stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.storage import forget, written

#: A node with more edges than this, or than an even share of all edges among so many nodes, is a centre.
CENTRE, MOST_CENTRES = 256, 10_000


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """edges (x, y) with m, the least of x's neighbours; least: x, n, m."""
    centres = least.filter(F.col("n") > many).select("x", F.col("m").alias("centre"))
    known = edges.join(F.broadcast(centres), "x", "left")
    rest = known.filter("centre is null").select("x", "y").join(least.filter(F.col("n") <= many).select("x", "m"), "x")
    return known.filter("centre is not null").select("x", "y", F.col("centre").alias("m")).unionByName(rest)


def _star(edges: DataFrame, large: bool, many: int) -> DataFrame:
    """Edges (x, y) with x > y."""
    n = F.count("*").alias("n")
    if large:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(n, F.least(F.min("y"), F.col("x")).alias("m"))
        out = _with_least(both.filter("y > x"), least, many).select(F.col("y").alias("x"), F.col("m").alias("y"))
    else:
        least = edges.groupBy("x").agg(n, F.min("y").alias("m"))
        out = _with_least(edges, least, many).select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
    return out.filter("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (x, y) -> node, part: the least node of the component; nodes without links have no row. Null ends are dropped."""
    ends = links.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    size = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
    edges = written(ends.distinct(), "links")
    was = size(edges)
    while was[0]:
        many = max(CENTRE, 2 * was[0] // MOST_CENTRES)
        half = written(_star(edges, True, many), "links")
        forget(edges)
        hooked = written(_star(half, False, many), "links")
        forget(half)
        edges, now = hooked, size(hooked)
        if now == was:
            break
        was = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("part")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("part")).distinct())
