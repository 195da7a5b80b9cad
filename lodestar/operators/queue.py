"""Job queues over keyed tables: coalescing, claims, recovery, retries and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """Requests of one document as one job: the best priority, how many there were, the first id."""
    return jobs.groupBy("document_id").agg(F.min("priority").alias("priority"), F.count(F.lit(1)).alias("requests"), F.min("job_id").alias("job_id"))


def claims(jobs: DataFrame, *by: str) -> DataFrame:
    """The next pending job of each worker pool: lowest priority number, then id."""
    first = F.min_by(F.struct("job_id", "document_id", "priority"), F.struct("priority", "job_id")).alias("job")
    return jobs.where("status = 'pending'").groupBy(*by).agg(first).select(*by, "job.*")


def fifo_claims(jobs: DataFrame) -> DataFrame:
    """Jobs that are due and have no earlier active job of their key."""
    active = jobs.where("status in ('pending', 'running')")
    first = Window.partitionBy("key").orderBy("job_id")
    return active.withColumn("nth", F.row_number().over(first)).where("nth = 1 and status = 'pending' and due").drop("nth")


def recover(jobs: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """Running jobs whose last sign of life is too old are pending again."""
    old = F.col("status").eqNullSafe("running") & (F.unix_timestamp(now) - F.unix_timestamp("ts") > timeout_seconds)
    return jobs.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def after_failure(jobs: DataFrame, most: int, base_seconds: int) -> DataFrame:
    """Failed jobs with their next state: retry after a doubling delay, or dead after `most` attempts."""
    dead = F.col("attempts") >= most
    return jobs.select("job_id", "attempts", F.when(dead, "dead").otherwise("retry").alias("state"), F.when(~dead, base_seconds * F.pow(2, F.col("attempts") - 1)).cast("long").alias("delay"))


def retain(jobs: DataFrame, newest: int, *by: str) -> DataFrame:
    """All but finished jobs, and of those the newest of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("job_id"))
    done = jobs.where("status = 'done'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= newest).drop("nth")  # each task keeps its newest before the shuffle
    return jobs.where("status <> 'done'").unionByName(done)
