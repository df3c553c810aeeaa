"""Reachability, orphans, depth and cycles over items(ld_id, id) and edges(ld_id, parent, child), level by level.

Each level is an equi-join of the frontier with the edges, without the items already seen; deep or large inputs have no
recursion limit. Every frontier is written once as a table of its own, so lineage and lost executors cost little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.shared import kept


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(ld_id, id, depth): everything below the roots (ld_id, id), with its least depth. Cycles end the walk."""
    edges = kept(edges.select("ld_id", "parent", "child"), "edges")
    levels = [kept(roots.select("ld_id", "id").distinct().withColumn("depth", F.lit(0)), "level")]
    while True:
        below = levels[-1].select("ld_id", F.col("id").alias("parent")).join(edges, ["ld_id", "parent"]).select("ld_id", F.col("child").alias("id")).distinct()
        found = kept(below.join(_union(levels).select("ld_id", "id"), ["ld_id", "id"], "left_anti").withColumn("depth", F.lit(len(levels))), "level")
        if found.isEmpty():
            return _union(levels)
        levels.append(found)


def orphans(items: DataFrame, roots: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Items that no root leads to; ``reached`` spares the walk."""
    reached = reachable(roots, edges) if reached is None else reached
    return items.join(reached.select("ld_id", "id"), ["ld_id", "id"], "left_anti")


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges that are left once items without children, or without parents, are taken away again and again."""
    n = edges.count()
    while n:
        heads, tails = edges.select("ld_id", F.col("child").alias("parent")).distinct(), edges.select("ld_id", F.col("parent").alias("child")).distinct()
        left = kept(edges.join(heads, ["ld_id", "parent"], "left_semi").join(tails, ["ld_id", "child"], "left_semi"), "edges")
        m = left.count()
        if m == n:
            break
        edges, n = left, m
    return edges


def cycles(edges: DataFrame, roots: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """(ld_id, id) of the items that lie on a cycle, that is: reach themselves; with ``roots`` (or what they reached), only below those.

    Items beside cycles are peeled off first. What is left of one description is followed from each of its items; descriptions
    are small programs, and their pairs stay among themselves.
    """
    if roots is not None or reached is not None:
        below = reachable(roots, edges) if reached is None else reached
        edges = edges.join(below.select("ld_id", F.col("id").alias("parent")), ["ld_id", "parent"], "left_semi")
    edges = _peeled(kept(edges.select("ld_id", "parent", "child").distinct(), "edges"))
    steps = [edges.select("ld_id", F.col("parent").alias("a"), F.col("child").alias("b"))]
    while not steps[-1].isEmpty():
        onward = steps[-1].join(edges.withColumnRenamed("parent", "b"), ["ld_id", "b"]).select("ld_id", "a", F.col("child").alias("b")).distinct()
        steps.append(kept(onward.join(_union(steps), ["ld_id", "a", "b"], "left_anti"), "paths"))
    return _union(steps).where("a = b").select("ld_id", F.col("a").alias("id")).distinct()


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ld_id", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
