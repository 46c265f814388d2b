"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to the smallest node around it."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them. Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of (a, b) with a < b; the component is the smallest id that is reachable.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest path; only a count and a
    checksum reach the driver. A node with very many neighbours costs aggregation and a join that Spark can split."""
    now, was = common.written(edges.select("a", "b").where("a < b").distinct(), "edges"), None
    while True:
        at = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum("a")).first()
        if at == was or not at[0]:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
        was = at
        after = common.written(_small_star(_large_star(now)), "edges")
        common.removed(now)
        now = after
