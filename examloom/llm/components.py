"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of ``links`` (columns a, b).

    Each round takes the smallest label among the neighbours, then follows the label once (pointer jumping), so
    the number of rounds grows with the logarithm of a chain's length.  Minima combine in the map tasks; a node
    with very many links is a skewed side of a join with one row per node, which adaptive execution splits.
    Only whether a label changed reaches the driver.
    """
    links = links.select("a", "b").where("a <> b")
    both = checkpointed(links.union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        root = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = step.join(root, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        moved = checkpointed(moved)
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
