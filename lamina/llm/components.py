"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, component): component is the smallest node reachable.

    Only nodes with a link to another node are returned; links with a null end are left out. Each step is a min-aggregate (combined
    before the shuffle), written, and an equi-join of two plain exchanges, which AQE can split where a
    node has very many links.
    """
    edges = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: every node's smaller neighbours, and the node itself, point to the smallest
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        stars = stored(small, "stars")
        released(edges, least, large, lowest)
        edges = stars
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
