"""Connected components by hooking and pointer jumping, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.session import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, label: the smallest node of the component; nodes of any type that has an order.

    In a round every node learns the smallest label's label around it; the node and its own label take it, if it is
    smaller, and every node takes its label's label. Labels of whole regions so move together, and the rounds grow with
    the logarithm of a chain's length. What a label with many nodes is told is aggregated before it is shuffled; labels
    stay distributed, and only whether any changed reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        known = labels.join(above, "label").select("node", "label", "above")
        near = both.join(known.select(F.col("node").alias("b"), "above"), "b").groupBy("a").agg(F.min("above").alias("least"))
        known = known.join(near.withColumnRenamed("a", "node"), "node")
        told = known.select("node", F.least("above", "least").alias("label"), F.col("label").alias("old"))
        told = told.union(known.select(F.col("label").alias("node"), F.col("least").alias("label"), F.lit(None).alias("old")))
        step = cut(told.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
