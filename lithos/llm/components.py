"""Connected components of a link table, with lineage cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, label: the smallest node of the node's component. Nodes without links do not appear.

    Each round gives every node the smallest label around it and then its label's own label, so that long chains halve.
    Labels and links stay distributed; only the number of changes reaches the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stored(step.join(jump, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        changed = not step.where("label <> old").isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels
