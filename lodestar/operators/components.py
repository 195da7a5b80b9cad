"""Equivalence classes of edges by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.tables import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder of spark.checkpoint.dir; a folder of our own only where there is none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def components(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), within `hops` steps if given.

    Unbounded, labels double their reach per round by pointer jumping.
    """
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = _cut(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    rounds = 0
    while hops is None or rounds < hops:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("before"))
        if hops is None:
            jump = low.select(F.col("node").alias("component"), F.col("component").alias("jump"))
            low = low.join(jump, "component", "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "before")
        low = _cut(low)
        labels = low.select("node", "component")
        rounds += 1
        if low.where("component <> before").isEmpty():
            break
    return labels
