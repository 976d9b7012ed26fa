"""Connected components by spreading least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges(a, b): label is the least node of the component.

    Least labels spread along edges and along labels (pointer jumping) until
    nothing changes, in about log2(diameter) rounds; each round is a table.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("_n"), F.col("label").alias("far"))
        step = labels.join(near, F.col("node") == F.col("a")).join(far, F.col("label") == F.col("_n"), "left")
        fresh = F.least("label", "near", F.coalesce("far", "label"))
        labels = materialise(step.select("node", fresh.alias("label"), (fresh != F.col("label")).alias("moved")), "labels")
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
