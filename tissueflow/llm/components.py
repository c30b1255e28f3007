"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: neighbours of each node are hung on the least of them.

    ``edges`` are deleted then. The least neighbours are written first, so that the join has a plain exchange on both sides and adaptive
    execution can split the rows of a node with very many neighbours.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = saved(out.filter("a <> b").distinct())
    forget(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (whole numbers) to ``(node, root)``: each node of an edge and the least node it reaches.

    Rows shrink to one edge per node; no group is collected, and each round is a table in the shared folder.
    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct())
    before = _digest(edges)
    while before[0]:
        edges = _star(_star(edges, True), False)
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
