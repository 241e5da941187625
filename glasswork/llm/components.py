"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswork.llm.inputs import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): the smallest node each node is connected to; only nodes with an edge appear.

    Each round a node takes the smallest label among its neighbours', then the
    label of that label, until nothing changes; pointer jumping halves the way
    along long chains. A hot node's edges are never gathered: its smallest
    neighbour is a combined minimum, the rest are joins.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        # A node takes the smallest label around it, then the label of its label (pointer jumping).
        around = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(
            F.min("theirs").alias("theirs"))
        near = labels.join(around, "a").select("a", "label", F.least("label", "theirs").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        moved = written(near.join(jump, "next").select("a", F.least("next", "far").alias("new"), "label"), "labels")
        changed = moved.filter("new != label").limit(1).count()
        labels = moved.select("a", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("a", "node")
