"""Edge-table operators; each round is a few joins, lineage is cut on reliable storage."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable. Min-label spreading with label jumping."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    lab = cut(nodes.select(F.col(node).alias("id")).distinct().withColumn("lab", F.col("id")))
    for _ in range(rounds):
        near = both.join(lab.select(F.col("id").alias("dst"), "lab"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("lab").alias("m"))
        step = lab.join(near, "id", "left").select("id", F.col("lab").alias("old"), F.least("lab", F.coalesce("m", "lab")).alias("lab"))
        # roots keep their own label, so only moved rows look up the label of their label
        up = step.select(F.col("id").alias("lab"), F.col("lab").alias("lab2"))
        root = step.where(F.col("lab") == F.col("id")).withColumn("lab2", F.col("lab"))
        moved = step.where(F.col("lab") != F.col("id")).join(up, "lab", "left")
        new = cut(moved.select("id", "old", F.least("lab", F.coalesce("lab2", "lab")).alias("lab"))
                  .unionByName(root.select("id", "old", "lab")))
        done = new.where(F.col("lab") != F.col("old")).isEmpty()
        lab = new.select("id", "lab")
        if done:
            return lab.select(F.col("id").alias(node), F.col("lab").alias("component"))
    raise ValueError("components did not settle")
