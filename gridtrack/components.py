"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import released, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that has an edge; label: the smallest node that it can reach.

    Each round takes the least label among neighbours, map-side combined, so that a node
    of many edges is no single task's work, and then replaces labels by their labels'
    labels, so that chains shorten by half. Rounds end when no label changes; more than
    max_rounds is an error, never a silent stop.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label"), F.lit(True).alias("moved")), "labels")
    for _ in range(max_rounds):
        own = labels.select("node", "label")
        near = both.join(own.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = own.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = own.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("old")).alias("moved"))
        before, labels = labels, staged(step, "labels")
        released(before)
        if labels.where("moved").isEmpty():
            released(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
