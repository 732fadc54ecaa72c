"""Distributed union-find: connected components of an edge table by alternating stars.

First each task joins the edges that it holds by itself and sends on one edge for each node. Then, round
by round, a large star hangs every larger neighbour under the smallest of a node's neighbourhood,
and a small star does the same for the smaller ones, until each node hangs under the smallest of its
component. The rounds grow with the logarithm of the longest path. Each round is written out, so lost
executors cost one round at most; only counts reach the driver. A hub's rows are aggregated before
they are dealt, and the join back to it is one that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace

#: Edges that a task joins at one time.
LOCAL_EDGES = 1_000_000


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node that is not the smallest of its component: the node and that smallest one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, parent = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] < parent).any():
            parent = parent[parent]
    under = parent < np.arange(len(nodes))
    return nodes[under], nodes[parent[under]]


def _contract(batches):
    """The edges of a task, joined some at a time."""

    def joined():
        u, v = local_forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    under = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return under.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node hangs under one other, and none that others hang under hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").count()


def connected(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) for each node of ``edges`` (long columns u and v, no null, u <> v); a
    component bears the smallest of its nodes. An empty edge table gives an empty result."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = space.save(now.mapInArrow(_contract, "u long, v long"), "edges")
    while not _is_forest_of_stars(now):
        after = space.save(_small_star(_large_star(now)), "stars")
        space.drop(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
