"""Connected components by alternating large-star and small-star steps, all as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import table


def _starred(edges: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other one to a node that has none."""
    ends = edges.select(F.col("x").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("y").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or out > 0 and into > 0").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every node of links(x, y): comp is the least node reachable.

    Each round is written to the shared folder. Rounds grow with the logarithm of a component's
    diameter. A hub's edges are spread by map-side minima and split joins.
    """
    edges = table(links.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        large = table(large, "large")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = table(small.select("e.*").filter("x <> y").distinct(), "edges")
    nodes = edges.select(F.col("x").alias("v"), F.col("y").alias("comp"))
    return table(nodes.unionByName(edges.select(F.col("y").alias("v"), F.col("y").alias("comp")).distinct()), "components")
