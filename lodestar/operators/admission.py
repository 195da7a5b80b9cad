"""Admission of entities and relations: reasons instead of silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A small ontology of our own: predicate, subject types, object types, words that signal it.
ONTOLOGY = [
    ("SUPPLIES", ["ORGANIZATION"], ["PERSON", "ORGANIZATION"], ["supply", "deliver"]),
    ("LOCATED_IN", ["PERSON", "ORGANIZATION"], ["PLACE"], ["in", "at"]),
    ("PLACED", ["PERSON"], ["ORDER"], ["order", "buy"]),
]
GENERIC = ("customer", "supplier", "company", "person", "unknown")


def rejection(name: Column) -> Column:
    """Why a name can't be an entity's, or null: shapes first, then generic words."""
    return (
        F.when(F.length(F.trim(name)) < 2, "too_short")
        .when(name.rlike(r"(?i)^(https?://|www\.)"), "url")
        .when(name.rlike(r"^[^@\s]+@[^@\s]+$"), "email")
        .when(name.rlike(r"^[0-9\s./-]+$"), "number")
        .when(name.rlike(r"(?i)\.(pdf|odt|txt|docx?|eml)$"), "file")
        .when(F.lower(F.trim(name)).isin(*GENERIC), "generic")
    )


def admitted(name: Column, kind: Column, score: Column) -> Column:
    """Struct (eligible, may_create, reason)."""
    why = F.coalesce(rejection(name), F.when(~kind.isin("PERSON", "ORGANIZATION", "PLACE"), "unknown_kind"), F.when(score < 0.3, "low_score"))
    return F.struct(why.isNull().alias("eligible"), (why.isNull() & (score >= 0.6)).alias("may_create"), F.coalesce(why, F.lit("ok")).alias("reason"))


def ontology(spark) -> DataFrame:
    return spark.createDataFrame(ONTOLOGY, "predicate string, domains array<string>, ranges array<string>, cues array<string>")


def checked_relations(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations (predicate, subject_type, object_type, evidence) with the reason against them, or 'ok'; the rules are a small dimension."""
    r = relations.join(F.broadcast(rules), "predicate", "left")
    reason = (
        F.when(F.col("domains").isNull(), "unknown_predicate")
        .when(~F.array_contains("domains", F.col("subject_type")), "domain")
        .when(~F.array_contains("ranges", F.col("object_type")), "range")
        .when(~F.exists("cues", lambda c: F.contains(F.lower("evidence"), c)), "no_cue")
        .otherwise("ok")
    )
    return r.withColumn("reason", reason).drop("domains", "ranges", "cues")


def compatible(rules: DataFrame, types: DataFrame) -> DataFrame:
    """Predicates that may hold between two types: (subject_type, object_type, predicate)."""
    by_domain = rules.select("predicate", "ranges", F.explode(F.array_distinct("domains")).alias("subject_type"))
    allowed = by_domain.select("predicate", "subject_type", F.explode(F.array_distinct("ranges")).alias("object_type"))
    return types.join(allowed, ["subject_type", "object_type"]).select("subject_type", "object_type", "predicate")


def grounded(evidence: Column, text: Column, forms: Column) -> Column:
    """Whether the evidence stands in the text and some form stands in the evidence."""
    return F.contains(text, evidence) & F.exists(forms, lambda f: F.contains(F.lower(evidence), F.lower(f)))
