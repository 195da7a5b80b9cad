"""Packing evidence into character budgets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_pack(records: DataFrame, budget: int, least: int) -> DataFrame:
    """The records of each query, in order, up to the budget; the first that doesn't fit is cut if `least` characters remain.

    records: query_id, rank, document_id, text. A running sum per query; queries' pools are bounded.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = records.withColumn("used", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
    room = F.lit(budget) - F.col("used")
    size = F.least(F.length("text"), room)
    return used.where((room >= F.length("text")) | (room >= least)).select("query_id", "rank", "document_id", size.cast("long").alias("kept"), (size < F.length("text")).alias("cut"))


def fair_share(records: DataFrame, budget: int) -> DataFrame:
    """All records stay, each with at most an equal share of the budget."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return records.select("query_id", "rank", "document_id", F.least(F.length("text"), F.floor(F.lit(budget) / n).cast("int")).cast("long").alias("kept"))


FITTED = "query_id long, n_records int, size int, payload string"


def fit_json(records: DataFrame, budget: int) -> DataFrame:
    """The longest run of leading records whose JSON list stays within the budget, the last one's text cut by halving."""

    def fit(pool: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        size = lambda extra: len(json.dumps([*kept, *extra], ensure_ascii=False))
        for r in pool.sort_values("rank").to_dict("records"):
            whole = {"id": r["document_id"], "text": r["text"]}
            if size([whole]) <= budget:
                kept.append(whole)
                continue
            low, high = 0, len(r["text"])
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size([whole | {"text": r["text"][:mid]}]) <= budget else (low, mid - 1)
            if low:
                kept.append(whole | {"text": r["text"][:low]})
            break
        payload = json.dumps(kept, ensure_ascii=False)
        return pd.DataFrame([(pool["query_id"].iloc[0], len(kept), len(payload), payload)], columns=["query_id", "n_records", "size", "payload"])

    return records.groupBy("query_id").applyInPandas(fit, FITTED)
