"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.sources.settle import forget, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the smallest node.

    Alternates the large-star and small-star steps, each a combined minimum per node
    and a join, until only stars are left; each step starts from a stored table, for plans of
    both hold the first one several times and take the driver's memory. So does each task, hence
    no shuffle more than these take. The number of rounds grows with the logarithm of the longest path.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # A node's link to its minimum stays, also where all its links point down; the others lead from the minimum.
        # Links that repeat, at most two for each, go in the next step.
        large = settle(
            both.join(least, "u").filter("v > u or v = m")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        )
        before, edges = edges, settle(small)
        forget(before, large)
        # Done when every node points to one node that itself points nowhere.
        ends = (
            edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            .union(edges.select("v", F.lit(0), F.lit(1)))
            .groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        )
        if ends.filter("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
