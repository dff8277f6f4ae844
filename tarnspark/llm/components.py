"""Connected components of a graph that no machine has to hold.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step hangs a node's neighbours on
the smallest node it knows, until all edges point at the smallest node of their component. Neighbour lists
are never gathered: each step is one minimum for each node and one equi-join. Every round is written to the
checkpoint folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges are (a, b) with a > b; so are the result's."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("_e")).select("_e.a", "_e.b")
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that an edge joins to another; null ends join nothing."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y"))
    now = cut(now.where((F.col("a") != F.col("b")) & F.col("_x").isNotNull() & F.col("_y").isNotNull()).select("a", "b").distinct())
    mark = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
        if not mark[0]:
            break
        now = cut(_star(_star(now, large=True), large=False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
