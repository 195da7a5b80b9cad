"""Score curves, strategies, reciprocal rank fusion and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
# Fixed values of the signal: its mixture, floors and the dominance tests.
HEAD, TAIL_SHARE, RELIABLE = 3, 0.33, 8
SMALL_FIELD, ANCHORED = 0.35, 0.45
FLOOR, RATIO, MARGIN, SECONDARY = 0.08, 1.5, 0.1, 0.2


def curve_profile(hits: DataFrame, *by: str) -> DataFrame:
    """Shape of each group's descending scores: head mean, tail median, spread, contrast, elbow and signal."""
    lists = hits.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False).alias("s"))
    n, top = F.size("s"), F.element_at("s", 1)
    scale = F.greatest(F.abs(top), F.lit(1e-9))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    tail = F.slice("s", n - F.col("tail_n") + 1, F.col("tail_n"))
    m = F.size("tail")
    median = (F.element_at("tail", F.floor((m + 1) / 2).cast("int")) + F.element_at("tail", F.floor(m / 2).cast("int") + 1)) / 2
    drops = F.transform(F.slice("s", 1, n - 1), lambda x, i: F.greatest((x - F.element_at("s", (i + 2).cast("int"))) / scale, F.lit(0.0)))
    out = lists.withColumn("tail_n", F.least(n, F.greatest(F.lit(1), F.ceil(n * TAIL_SHARE).cast("int"))))
    out = out.withColumn("tail", tail).withColumn("drops", drops)
    out = out.select(
        *by,
        n.alias("count"),
        top.alias("top_score"),
        mean(F.slice("s", 1, HEAD)).alias("head_mean"),
        median.alias("tail_median"),
        F.coalesce(F.array_max("drops"), F.lit(0.0)).alias("elbow_strength"),
        F.when(n >= 2, F.array_position("drops", F.array_max("drops"))).alias("elbow_rank"),
        scale.alias("scale"),
    )
    spread = F.greatest((F.col("top_score") - F.col("tail_median")) / F.col("scale"), F.lit(0.0))
    contrast = F.greatest((F.col("head_mean") - F.col("tail_median")) / F.col("scale"), F.lit(0.0))
    raw = F.least(F.greatest(0.55 * contrast + 0.25 * spread + 0.2 * F.col("elbow_strength"), F.lit(0.0)), F.lit(1.0))
    signal = F.when(F.col("count") < RELIABLE, F.greatest(raw, F.lit(SMALL_FIELD))).otherwise(raw)
    return out.select(*by, "count", "top_score", "head_mean", "tail_median", spread.alias("relative_spread"), contrast.alias("head_contrast"), "elbow_strength", "elbow_rank", raw.alias("raw_signal"), signal.alias("signal"), (F.col("count") >= RELIABLE).alias("reliable"))


def strategy(lexical: Column, lexical_reliable: Column, vector: Column, vector_reliable: Column) -> Column:
    """Struct (strategy, lexical_weight, vector_weight) from two signals, null where an arm has no hits."""
    pick = lambda name, a, b: F.struct(F.lit(name).alias("strategy"), (F.lit(a) if isinstance(a, float) else a).alias("lexical_weight"), (F.lit(b) if isinstance(b, float) else b).alias("vector_weight"))
    weak_l, weak_v = lexical_reliable & (lexical < FLOOR), vector_reliable & (vector < FLOOR)
    beats = lambda a, b: (a >= b * RATIO) & (a - b >= MARGIN)
    share = lambda a, b: F.greatest(F.lit(SECONDARY), F.least(F.lit(1.0), b / F.greatest(a, F.lit(1e-9))))
    no_l, no_v = lexical.isNull(), vector.isNull()
    return (
        F.when(no_l & no_v, pick("no_results", 0.0, 0.0))
        .when((no_v & weak_l) | (no_l & weak_v) | (weak_l & weak_v), pick("unspecific", 0.0, 0.0))
        .when(no_v, pick("lexical", 1.0, 0.0))
        .when(no_l, pick("vector", 0.0, 1.0))
        .when(weak_l, pick("vector", SECONDARY, 1.0))
        .when(weak_v, pick("lexical", 1.0, SECONDARY))
        .when(beats(lexical, vector), pick("lexical", 1.0, share(lexical, vector)))
        .when(beats(vector, lexical), pick("vector", share(vector, lexical), 1.0))
        .otherwise(pick("fusion", 1.0, 1.0))
    )


def weighted_rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, document_id, rrf, arms, best ranks, rank) from (query_id, arm, document_id, rank, weight).

    A union grouped once instead of outer joins: one shuffle for any number of arms.
    """
    fused = hits.groupBy("query_id", "document_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("rrf"),
        F.array_sort(F.collect_set("arm")).alias("arms"),
        F.min(F.when(F.col("arm") == "files", F.col("rank"))).alias("files_rank"),
        F.min(F.when(F.col("arm") == "vector", F.col("rank"))).alias("vector_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("files_rank"), F.asc_nulls_last("vector_rank"), "document_id")
    return fused.withColumn("rank", F.row_number().over(order))


def probe_rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Unweighted fusion of probes; a document counts once per probe, at its first place."""
    first = hits.groupBy("query_id", "probe", "document_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id", "document_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf"), F.count(F.lit(1)).alias("probes"), F.min("rank").alias("best_rank"))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of common documents among the first k of two rankings, over the shorter one."""
    ids = lambda d, c: d.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("document_id").alias(c))
    both = ids(a, "x").join(ids(b, "y"), "query_id", "full")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("x", "y"))
    least = F.least(F.size(x), F.size(y))
    common = F.size(F.array_intersect(x, y))
    return both.select("query_id", common.alias("common"), F.when(least > 0, F.round(common / least, 6)).otherwise(0.0).alias("ratio"))


def admit(fused: DataFrame, hits: DataFrame, heads: int, limit: int) -> DataFrame:
    """The first `heads` of every arm, then the fused order, up to the limit."""
    head = hits.where(F.col("rank") <= heads).select("query_id", "document_id").distinct().withColumn("head", F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("head"), "rank")
    return fused.join(head, ["query_id", "document_id"], "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def keep_required(ranked: DataFrame, limit: int) -> DataFrame:
    """Required rows stay within the limit at the cost of the lowest others; the order stays."""
    member = Window.partitionBy("query_id").orderBy(F.desc("required"), "rank")
    kept = ranked.withColumn("m", F.row_number().over(member)).where(F.col("m") <= limit)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("m")
