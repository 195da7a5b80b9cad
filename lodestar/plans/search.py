"""Whole retrievals over batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import fusion


def fused_search(hits: DataFrame, allowed: DataFrame, limit: int) -> DataFrame:
    """Arms weighted by the strategy that their score curves suggest, fused, cut to the limit, then authorized.

    hits: query_id, arm (files or vector), document_id, rank, score. Queries whose lists are flat
    have mode 'unspecific' and no rows. Denied documents aren't replaced.
    """
    c = fusion.curve_profile(hits, "query_id", "arm")
    of = lambda arm, v: F.max(F.when(F.col("arm") == arm, F.col(v)))
    b = c.groupBy("query_id").agg(of("files", "signal").alias("x"), of("files", "reliable").alias("rx"), of("vector", "signal").alias("y"), of("vector", "reliable").alias("ry"))
    no = F.lit(False)
    plan = b.select("query_id", fusion.strategy(F.col("x"), F.coalesce("rx", no), F.col("y"), F.coalesce("ry", no)).alias("s")).select("query_id", "s.*")
    weight = F.when(F.col("arm") == "files", F.col("lexical_weight")).otherwise(F.col("vector_weight"))
    weighted = hits.join(plan, "query_id").where("strategy <> 'unspecific'").select("query_id", "arm", "document_id", "rank", F.round(weight, 6).alias("weight"), "strategy")
    fused = fusion.weighted_rrf(weighted).where(F.col("rank") <= limit)
    kept = fused.join(allowed, "document_id", "left_semi").join(plan.select("query_id", F.col("strategy").alias("mode")), "query_id")
    return kept.select("query_id", "mode", "document_id", "rrf", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))


def select_per_batch(pages: DataFrame, per_batch: int, most: int) -> DataFrame:
    """The best pages of each batch of hits, then the best of all within the overall number."""
    order = Window.partitionBy("batch").orderBy(F.desc("score"), "url")
    first = pages.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_batch)
    once = first.groupBy("url").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("batches"))
    return once.orderBy(F.desc("score"), "url").limit(most)
