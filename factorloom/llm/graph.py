"""Connected components of links, by minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node of links (a, b): label is the smallest node reachable.

    Each round takes the smallest label of a node and its neighbours, then the label's own label, so long chains shrink
    fast; rounds go on until nothing changes. Labels are checkpointed, sums combine before each shuffle.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = checkpointed(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = checkpointed(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
