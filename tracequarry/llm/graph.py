"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (least id of the component) for every node of edges (a, b).

    Alternating large and small stars; rounds grow with the logarithm of the nodes. Minima are combined before each
    shuffle; nodes grow with the data, so joins are sort-merge joins, which Spark can split on a hub's key. Each round is cut off by checkpoint().
    """
    state = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    before = None
    for _ in range(most):
        state = _small_star(_large_star(state)).checkpoint()
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"no fixed point after {most} rounds")
