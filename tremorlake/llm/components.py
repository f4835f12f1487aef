"""Connected components by large-star and small-star steps.

Every step is a minimum per node (combined on the map side) joined back to the edges, so a node with very
many edges is never gathered; edges are written down after each round, which ends the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import cut, gathered


def _star(pairs: DataFrame) -> DataFrame:
    """pairs: u, v.  For every pair (v, smallest neighbour of u), u among its own neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), F.xxhash64("u").alias("j"))
    # the derived key makes both sides plain exchanges, whose hot keys AQE can split
    return pairs.withColumn("i", F.xxhash64("u")).join(least, (F.col("u") == F.col("w")) & (F.col("i") == F.col("j")))


def _digest(edges: DataFrame) -> tuple:
    """Of a set of edges; one small job tells whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs).  node, component: the smallest node that it reaches, for every node with an edge to another."""
    now = cut(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    seen = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _star(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(gathered(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
