"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    which halves long paths, until no label changes. Minima are taken before the shuffle, so a node with a
    third of all links is one row per task. Each round is a written table, so a lost executor costs one
    round at most."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = staged(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        far = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = staged(step.join(far, "component").select("node", "old", F.least("component", "far").alias("component")))
        if moved.where("old != component").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
