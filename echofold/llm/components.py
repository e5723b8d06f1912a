"""Connected components by smallest label, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.spark_util import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b); loops and repeats do no harm.

    Each round takes the least label among neighbours and then that label's own label, so chains halve.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        stepped = near.join(labels, near["a"] == labels["node"]).select("node", F.least("m", "component").alias("component"), F.col("component").alias("before"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(stepped.join(own, "component").select("node", F.least("component", "further").alias("component"), "before"))
        changed = moved.where("component <> before").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
