"""Retrieval over relation observations and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def direct_relations(observations: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges whose two different ends are both among the asked entities."""
    ids = asked.select("entity_id")
    kept = observations.join(ids.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("entity_id", "object"), "object", "left_semi")
    return kept.where("subject <> object").groupBy("subject", "object", "predicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))


def observed_documents(observations: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents that state a relation between two asked entities, rolled up."""
    ids = asked.select("entity_id")
    kept = observations.join(ids.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("entity_id", "object"), "object", "left_semi")
    return kept.where("subject <> object").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))


def mentioning_all(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents that mention every entity of a group (group_id, entity_id), with their mentions added up; all groups at once."""
    wanted = groups.distinct()
    found = mentions.join(wanted, "entity_id").groupBy("group_id", "document_id").agg(F.count_distinct("entity_id").alias("entities"), F.sum("mentions").alias("mentions"))
    return found.join(wanted.groupBy("group_id").agg(F.count(F.lit(1)).alias("entities")), ["group_id", "entities"]).select("group_id", "document_id", "entities", "mentions")


def bridges(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities that both ends of a pair (pair_id, side: a or b, entity_id) relate to; all pairs at once.

    (pair_id, bridge, the first document and the number of observations of both sides). An end is no bridge of its own pair.
    """
    ends = observations.select("document_id", F.col("subject").alias("entity_id"), F.col("object").alias("bridge")).unionByName(observations.select("document_id", F.col("object").alias("entity_id"), F.col("subject").alias("bridge")))
    of = lambda s, c: F.when(F.col("side") == s, c)
    met = ends.join(pairs, "entity_id").groupBy("pair_id", "bridge").agg(*(f for s in "ab" for f in (F.min(of(s, F.col("document_id"))).alias(f"document_{s}"), F.count(of(s, F.lit(1))).alias(f"n_{s}"))))
    own = pairs.select("pair_id", F.col("entity_id").alias("bridge"))
    return met.where("n_a > 0 and n_b > 0").join(own, ["pair_id", "bridge"], "left_anti")


def ladder(*tiers: DataFrame) -> DataFrame:
    """(query_id, document_id, score): of each query the rows of its first tier that has any."""
    each = None
    for i, t in enumerate(tiers):
        part = t.select("query_id", "document_id", "score", F.lit(i).alias("tier"))
        each = part if each is None else each.unionByName(part)
    first = each.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return each.join(first, ["query_id", "tier"])
