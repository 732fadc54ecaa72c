"""Connected components of an edge table, by alternating stars in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scratch import Scratch


def _upward(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes under the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _downward(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go under the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.toDF("u", "v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of each node of ``edges`` (columns u and v of one orderable type); a component
    bears its smallest node. The rounds grow with the logarithm of the longest path, and only counts
    reach the driver. Rows with a null end, and edges from a node to itself, link nothing."""
    tidy = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = scratch.save(tidy), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        now, before = scratch.save(_downward(_upward(now))), mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
