"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import dropped, written


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of the label, so
    that long chains shorten by half and more. Tables are written to the shared folder between
    rounds; only the count of changes reaches the driver.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        .filter(F.col("a") != F.col("b")).distinct()
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")
    ))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a")
            .agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        )
        closer = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(
            closer.join(jump, "label", "left").select(
                "node", "before", F.least("label", F.coalesce("next", "label")).alias("label")
            )
        )
        changed = after.filter(F.col("before") != F.col("label")).limit(1).count()
        dropped(labels)
        labels = after.select("node", "label")
        if changed == 0:
            dropped(both)
            return labels
