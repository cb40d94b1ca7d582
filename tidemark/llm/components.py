"""Connected components by alternating large and small stars; every round is aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component. Loops and repeats are allowed.

    The smallest neighbour of a node is aggregated with map-side combine and joined back, so a node with very many
    links needs no task of its own. Rounds grow with the logarithm of the longest path.
    """
    edges = stage.write(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    last, k = None, 0
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last, k = seen, k + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first: with a plain shuffle on both sides of the join, a node with very many links can be split
        low = stage.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-{k}l")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage.write(large, f"{name}-{k}a")
        low = stage.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}s")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = stage.write(small, f"{name}-{k}b")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
