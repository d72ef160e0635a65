"""Connected components of an edge table, in rounds that stay on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b).

    Every round hangs the larger neighbours of a node, and then the node itself, on its
    smallest neighbour. Chains shorten by half a round, so their number grows with the
    logarithm of the longest path. Minima are aggregated map-side, and the joins are
    equality joins that AQE splits at a hot node. Null ends and loops are left out.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or state == before:
            break
        before = state
        # larger neighbours go to the smallest one: b > u becomes (least(u, min), b)
        ways = _both_ways(links)
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = cut(large)
        # a node and its smaller neighbours go to the smallest one of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        links = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    # every link is now (root, node)
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
