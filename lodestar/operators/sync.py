"""Delta synchronisation and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(inventory: DataFrame, current: DataFrame, signature: str, complete: bool = True) -> DataFrame:
    """(document_id, change): new, changed, reindex (another signature), unchanged or stale.

    inventory: document_id, content_hash, index_signature; current: document_id, content_hash. Only
    a complete scan may call documents stale: after a pause, what wasn't seen isn't gone.
    """
    old = inventory.select("document_id", F.col("content_hash").alias("old_hash"), "index_signature", F.lit(True).alias("known"))
    new = current.select("document_id", "content_hash", F.lit(True).alias("seen"))
    both = old.join(new, "document_id", "full")
    change = (
        F.when(F.col("seen").isNull(), "stale")
        .when(F.col("known").isNull(), "new")
        .when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "changed")
        .when(~F.col("index_signature").eqNullSafe(F.lit(signature)), "reindex")
        .otherwise("unchanged")
    )
    out = both.select("document_id", change.alias("change"))
    return out if complete else out.where("change <> 'stale'")


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The table with rows of the same key replaced; idempotent by key."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows.select(*table.columns))


def upsert_filled(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replaces values by key, but blanks and nulls don't overwrite what is there."""
    fields = [c for c in table.columns if c != key]
    joined = table.alias("t").join(rows.alias("r"), key, "full")
    return joined.select(key, *(F.coalesce(F.expr(f"nullif(trim(r.{c}), '')"), F.col(f"t.{c}")).alias(c) for c in fields))


def delete_range(chunks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chunks whose number isn't in [first, end) of their document's bounds."""
    return chunks.join(bounds, "document_id", "left").where("first is null or chunk_no < first or chunk_no >= `end`").drop("first", "end")
