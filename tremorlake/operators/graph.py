"""Connected components by repeated minima, with no group gathered and the lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """edges a, b.  node_id, component: the smallest node reachable, for every node with an edge.

    Each round gives a node the smallest label of itself and its neighbours and then follows the label's own
    label, so chains shorten by more than half; it ends when no label changes."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.where("a <> b").select(F.inline(ways)).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node_id")).groupBy("a").agg(F.min("component").alias("m"))
        better = labels.join(near, F.col("node_id") == F.col("a"), "left").select("node_id", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("node_id").alias("via"), F.col("component").alias("further"))
        after = cut(better.join(jump, F.col("c") == F.col("via"), "left").select("node_id", F.least("c", F.coalesce("further", "c")).alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "was"), "node_id").where("component <> was").isEmpty()
        labels = after
        if changed:
            return labels
