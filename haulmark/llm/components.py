"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.tables import keep


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for all nodes of ``links`` (a, b: long).

    Labels go over links and are then followed one step (pointer jumping), so the rounds grow with
    the logarithm of the longest path.  Minima are taken before the shuffle, so a node with many
    links is no hot group; every round is written to the shared folder.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = keep(labels, "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        low = keep(low, "labels")
        follow = low.select(F.col("node").alias("target"), F.col("low").alias("further"))
        jumped = low.join(follow, F.col("low") == F.col("target")).select(
            "node", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("moved")
        )
        jumped = keep(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
