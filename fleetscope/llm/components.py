"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A node with more than 1 / HUB_SHARE of all edge ends (and more than HUB_LEAST) is a hub; there are HUB_SHARE hubs at most.
HUB_SHARE, HUB_LEAST = 4096, 64
#: Rounds before the search is given up with an error; their number follows the logarithm of the longest chain.
MOST_ROUNDS = 60


def _beside_lowest(rows: DataFrame, ends: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (u, v) beside m, the lowest v of their u; and the table (u, m) of that.

    What joins a hub is broadcast (HUB_SHARE rows at most), so that no task gets all edges of a hub.
    """
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hub = F.col("n") > max(HUB_LEAST, ends // HUB_SHARE)
    marked = rows.join(F.broadcast(low.where(hub).select("u", "m")), "u", "left")
    others = marked.where("m IS NULL").drop("m").join(low.where(~hub).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").unionByName(others), low


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of u moves to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    beside, _ = _beside_lowest(both, 2 * n)
    return beside.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """u (the larger end) and its smaller neighbours move to the smallest of those."""
    beside, low = _beside_lowest(edges, n)
    moved = beside.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that ``edges`` (a, b) names; root is the smallest node reached.

    Hubs are never gathered: a step is a minimum (combined before its shuffle) and a join in which hubs are broadcast. Every
    step is written to the shared folder. Self loops and repeated edges are allowed, null ends are not.
    """
    cur = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        larger = scratch.cut(large_star(cur, mark[0]))
        nxt = scratch.cut(small_star(larger, mark[0]))
        for done in (cur, larger):
            scratch.drop(done)
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
