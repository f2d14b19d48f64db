"""Connected components of links, by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.session import stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b), root being the smallest node of its component.

    Each step hangs neighbours under the smallest one known; rounds grow with the logarithm of the nodes. The smallest neighbours are
    written before they are joined back, so that adaptive execution can split a node with many links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stage(edges, "links")
    known = _state(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "links")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, known = known, _state(edges)
        if before == known:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
