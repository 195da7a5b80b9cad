"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next stage's docs. All but the last return the columns of documents; the last returns one row per
document of the mixture, with its tokens' count and digests. SQL can't express the classifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, exact_dedup, ngram_join, quality, source_mix
from lodestar.llm.common import Staged
from lodestar.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("quality_kept").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.deduplicate(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one stays."""
    return ngram_join.one_per_group(docs.select(*COLUMNS))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mixture takes them."""
    return source_mix.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of the mixture."""
    return bpe.encode_documents(docs, keep_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mixture", source_mixture),
    ("BPE encoding", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged.put(docs)
    return docs
