"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortwise.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.select(F.col("big").alias("node"), F.col("small").alias("other")).union(
        edges.select(F.col("small").alias("node"), F.col("big").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return edges.join(least, edges.small == least.node).select("big", F.col("least").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    joined = edges.join(least.withColumnRenamed("big", "node"), F.col("big") == F.col("node"))
    moved = joined.where("small > least").select(F.col("small").alias("big"), F.col("least").alias("small"))
    return moved.union(least.select("big", F.col("least").alias("small"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (two columns of longs); component is the least node reachable.

    Rounds of both operations, each checkpointed in the cluster's shared folder, until nothing
    changes; a component of n nodes takes about log n rounds at most. Only a count and a hash sum
    come to the driver. Neighbours are aggregated, never listed, so a node with very many is a
    sum like any other. Self-links and null ends are left out.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"), F.col(a).isNull() | F.col(b).isNull())
    edges = edges.toDF("big", "small", "void").where("not void and big != small").select("big", "small").distinct()
    seen = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(big, small))")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).union(
        edges.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())
