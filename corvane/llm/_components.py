"""Connected components by minimum labels and pointer jumping, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import staged


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp) for every node on an edge; comp is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    jumps to the label of that label.  Rounds end when no label changes; labels
    are written to the shared folder, so lost executors cost no earlier round.
    """
    both = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        new = staged(lower.join(jump, "low", "left").select("node", F.least("low", "next").alias("comp"), (F.least("low", "next") < F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels
