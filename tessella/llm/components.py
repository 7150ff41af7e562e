"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours (a map-side-combined aggregate), then
    follows the label's own label, so the rounds grow with the logarithm of the longest path. State is cut by
    checkpoint() each round; nothing but one count comes to the driver.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a union would find all edges twice
    both = checkpoint(edges.where("a <> b").select(F.inline(ways)).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        new = checkpoint(hooked.join(up, "mid").select("node", "old", F.least("mid", "up").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
