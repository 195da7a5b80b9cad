"""Filters and classifications over corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.paths import extension

# Containers and media types without text of their own, and extensions of text documents.
BLOCKED_EXTENSIONS = ("eml", "msg", "zip", "7z", "rar", "tar", "gz")
BLOCKED_TYPES = ("message/rfc822", "application/zip", "application/x-7z-compressed")
BLOCKED_TYPE_PREFIXES = ("multipart/",)
TEXT_EXTENSIONS = ("txt", "md", "pdf", "odt", "ods", "odp", "doc", "docx", "rtf", "html", "csv")

SECRETS = {
    "bearer": r"(?i)bearer\s+[A-Za-z0-9._~+/-]{16,}",
    "assignment": r"(?i)(?:token|secret|password|api_key|apikey)\s*[=:]\s*[\"']?[A-Za-z0-9._~+/-]{12,}[\"']?",
    "access_key": r"AKIA[0-9A-Z]{16}",
}


def eligibility(path: Column, content_type: Column, content: Column, min_chars: int = 0) -> Column:
    """Why a document is or isn't indexed: 'allowed' or the first rule against it.

    The type has a say only where the extension isn't one of a text document.
    """
    suffix, kind = extension(path), F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    vetoes = ~suffix.isin(*TEXT_EXTENSIONS)
    prefixed = F.lit(False)
    for p in BLOCKED_TYPE_PREFIXES:
        prefixed = prefixed | kind.startswith(p)
    return (
        F.when(F.lower(path).endswith(".mailmeta.json"), "machine_mailmeta")
        .when(suffix.isin(*BLOCKED_EXTENSIONS), F.concat(F.lit("excluded_extension:"), suffix))
        .when(vetoes & kind.isin(*BLOCKED_TYPES), F.concat(F.lit("excluded_mime:"), kind))
        .when(vetoes & prefixed, F.concat(F.lit("excluded_mime_prefix:"), kind))
        .when(F.length(F.trim(content)) < min_chars, "text_too_short")
        .otherwise("allowed")
    )


def may_read(user: str, groups: list[str] | None) -> Column:
    """Owner, named user or member of a named group. Without a group list the prefilter is off; an empty list is a list."""
    if groups is None:
        return F.lit(True)
    named = (F.col("owner") == user) | F.array_contains("users", user)
    return named | F.arrays_overlap("groups", F.array(*map(F.lit, groups))) if groups else named


def redacted(text: Column) -> tuple[Column, Column]:
    """(text with credentials replaced, how many there were)."""
    count, out = F.lit(0), text
    for pattern in SECRETS.values():
        count = count + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return out, count


def hard_constraints(text: Column) -> Column:
    """Years, dates and identifiers that a question states literally; each once, in order."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    return F.struct(
        find(r"\b((?:19|20)[0-9]{2})\b").alias("years"),
        find(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})\b").alias("dates"),
        find(r"\b([A-Z]{2,}[-/][0-9]{2,}[-/0-9A-Z]*)\b").alias("identifiers"),
    )


def satisfying(candidates: DataFrame, constraints: DataFrame) -> DataFrame:
    """Candidates (query_id, document_id, content) that hold every value of their query.

    A query whose candidates all fail keeps them all: the constraint then was no fit for the corpus.
    """
    wanted = constraints.groupBy("query_id").agg(F.collect_set("value").alias("wanted"))
    tested = candidates.join(wanted, "query_id", "left").withColumn("holds", F.forall(F.coalesce("wanted", F.array().cast("array<string>")), lambda v: F.contains("content", v)))
    any_ = tested.groupBy("query_id").agg(F.bool_or("holds").alias("some"))
    return tested.join(any_, "query_id").where(F.col("holds") | ~F.col("some")).drop("wanted", "holds", "some")
