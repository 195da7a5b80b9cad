"""Polling workers as Structured Streaming queries that process what is available and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream; its schema comes from the file, declared once."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/{name}.parquet*")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all available input into a table of the shared folder and reads it."""
    spark, root = df.sparkSession, _folder(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def coalesced_jobs(events: DataFrame) -> DataFrame:
    """Requests per user as keyed state: best priority, count and first id, updated with every batch."""
    return events.groupBy("user_id").agg(F.min("value").alias("priority"), F.count(F.lit(1)).alias("requests"), F.min("event_id").alias("job_id"))


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """An extension of ours: event-time windows with a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")
