"""Connected components by alternating star contractions, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs (u, v): hang neighbours of u on the least of u's neighbours and u. large: those over u; else u itself and those under it."""
    # Written, so that the join with it is of two plain exchanges: Spark then splits the arcs of a hub.
    least = written(arcs.groupBy("u").agg(F.min("v").alias("m")))
    if large:
        joined = arcs.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.least("m", "u").alias("a"))
    else:
        joined = arcs.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return joined.filter("a < b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of long numbers; root is the component's least node.

    Rounds grow with the logarithm of the longest chain. Each holds as many edges as there were at most, and is
    written to the shared folder, so a lost executor costs one round. Nothing but two sums reaches the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = _state(now)
    while state[0]:
        arcs = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(arcs, True)
        now = written(_star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), False))
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
