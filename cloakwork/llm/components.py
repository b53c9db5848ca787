"""Connected components of a table of links, by alternating large and small stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest node it knows (itself included) to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of these. In ``edges`` u is larger than v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    passed = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return passed.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of ``links`` (two long columns); nodes without links aren't in it.

    Links to itself and repeated links change nothing. Every round is a written table, so its result outlives executors.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "links")
    while True:
        edges = materialise(_small(_large(edges)), "stars")
        # Done when the links are stars: no node has two parents, and no parent has one.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child > 0 and parent > 0").count():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
