"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: the label is the smallest node of the component.

    Each round gives a node the smallest label around it, then the label of that label; the number of
    rounds grows with the logarithm of the longest path. All state is in written tables.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        after = materialize(after, "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
