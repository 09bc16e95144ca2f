"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node of ``links`` (x, y: longs). Nothing is collected.

    Every round a node takes the least label of its neighbours, and then its label's label; the rounds needed grow with
    the logarithm of the longest path in usual graphs.
    """
    both = links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        low = written(low, "labels")  # so that the join below has plain shuffles, of which a large component's can be split
        up = low.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = low.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("higher", "component")).alias("component"))
        new = written(new, "labels")
        labels = new.select("node", "component")
        if new.where(F.col("was") != F.col("component")).isEmpty():
            return labels
