"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.shared import attach, stage


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of ``links`` (a, b: long).

    A round gives every node the smallest label among its own, its neighbours' and its label's label. Links of a
    heavy node are not shuffled to one task, and every round is a staged table.
    """
    both = links.filter("a != b").select("a", "b").unionByName(links.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.distinct(), "links")
    start = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = stage(start, "labels")
    while True:
        near = attach(edges, labels.select(F.col("node").alias("b"), "label", "degree"), "b", "degree")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        merged = stage(
            labels.join(least, "node").select("node", F.least("label", "near").alias("label"), "degree", F.col("label").alias("old")), "merged"
        )
        heads = merged.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        jumps = heads.join(merged.select(F.col("node").alias("label"), F.col("label").alias("head")), "label")
        jumped = attach(merged, stage(jumps, "jumps"), "label", "members")
        moved = stage(jumped.select("node", F.least("label", "head").alias("label"), "degree", "old"), "labels")
        if moved.filter("label != old").isEmpty():
            return moved.select("node", "label")
        labels = moved.drop("old")
