"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is two aggregations and joins over the edges; the number of rounds grows with
the logarithm of the longest chain. Nothing is collected: only the count of changed
edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; an edge (a, b) always has a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a: the centre, b: its neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        linked = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.where(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least member of the component of each node that isn't itself the least.

    ``edges`` has columns ``a`` and ``b`` of one orderable type, undirected; loops, nulls and
    repeated edges are ignored. Returns ``a`` (node) and ``b`` (least member). A node
    that is the least of its component, or has no edge, has no row.
    """
    start = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = staged(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        # a forest of stars: no centre is a leaf, no leaf has two centres
        tangled = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").union(
            now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
        )
        if tangled.isEmpty():
            return now
        now = staged(_star(_star(now, large=True), large=False), "components")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
