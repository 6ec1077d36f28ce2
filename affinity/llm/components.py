"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so long
    chains close in few rounds. Labels are written as a table after each round; only the number of
    changes reaches the driver. A hub is one key of a plain join and is split by the runtime.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.filter("u <> v")
    edges = cut_lineage(both.union(both.select("v", "u")).distinct())
    labels = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = cut_lineage(labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l")))
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("far"))
        labels = cut_lineage(step.join(jump, "l").select("u", "old", F.least("l", "far").alias("l")))
        if labels.filter("old <> l").limit(1).count() == 0:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
        labels = labels.select("u", "l")
