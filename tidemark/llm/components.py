"""Connected components of a graph too large for one task.

Alternating large-star and small-star passes: every node's larger (then smaller)
neighbours are hung on its smallest neighbour until the graph is a set of stars.
The number of passes grows with the logarithm of the longest chain.  Each pass is
written to the shared folder, so a lost executor costs one pass at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one.  A hub meets its neighbours in a join,
    whose large side run-time planning can split; only minima are grouped by node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("c"), F.least("u", "low").alias("m"))
    joined = both.join(least, both.u == least.c)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_passes: int = 64) -> DataFrame:
    """``edges`` (u, v: bigint, u <> v) to (node, root): each node's smallest reachable node.

    Nodes without an edge are not returned.
    """
    stars = pin(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_passes):
        # u > v holds on every edge: small-star looks at smaller neighbours only
        stars = pin(_star(_star(stars, True), False))
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            root = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return root.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components not settled after {most_passes} passes")
