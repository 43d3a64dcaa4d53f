"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of every node, combined before the shuffle, so hub nodes are one row per task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step: a node's neighbours (the larger ones, or the node itself and the smaller ones) move to its smallest."""
    least = _smallest(pairs)
    least = least.select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    # The hub's pairs are split by adaptive execution: one small row per node stands on the other side.
    met = pairs.join(least, pairs["u"] == least["w"])
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge names. Edges with a null are ignored.

    Every step only replaces edges, so the table never outgrows its input, and each is written to the shared
    checkpoint folder. The number of steps grows with the logarithm of the number of nodes.
    """
    apart = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = apart.select("u").union(apart.select("v")).distinct()
    pairs = kept_once(apart.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = kept_once(_star(_star(both, True), False))
    roots = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots.withColumnRenamed("u", "w"), F.col("u") == F.col("w"), "left").select(
        F.col("u").alias("node"), F.coalesce("m", "u").alias("root"))
