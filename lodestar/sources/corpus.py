"""The corpus view: documents with paths, origins, owners and dates derived from the driver's table.

The table has no paths or owners, so they follow from doc_id by fixed rules. CORPUS is the
same view in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import table

ROOTS = ("Archive/Mail", "Archive/Chats", "Archive/Web")
EXTENSIONS = ("txt", "md", "pdf", "odt", "png", "eml", "")
TYPES = ("text/plain", "text/markdown", "application/pdf", "application/vnd.oasis.opendocument.text", "image/png", "message/rfc822", "application/zip")

CORPUS = """
corpus AS (
  SELECT 'files:' || doc_id AS document_id, doc_id, source,
    CASE doc_id // 2 % 10 WHEN 0 THEN 'Archive/Mail' WHEN 1 THEN 'Archive/Chats' WHEN 2 THEN 'Archive/Web' ELSE 'Docs' END || '/src' || (doc_id // 2 % 20) || '/'
      || CASE WHEN doc_id % 50 = 3 THEN '.' ELSE '' END || 'Report_' || (doc_id // 2)
      || CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.odt' WHEN 4 THEN '.png' WHEN 5 THEN '.eml' ELSE '' END AS path,
    CASE doc_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.oasis.opendocument.text'
      WHEN 4 THEN 'image/png' WHEN 5 THEN 'message/rfc822' ELSE 'application/zip' END AS content_type,
    text AS content, md5(text) AS content_hash, lang, n_chars,
    CAST(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER) AS DATE) AS document_date,
    'user' || (doc_id % 17) AS owner,
    ['user' || (doc_id % 5), 'user' || (doc_id % 11)] AS users,
    ['group' || (doc_id % 3), 'group' || (doc_id % 7)] AS groups
  FROM documents
)
"""


def _choice(n: Column, values: tuple[str, ...], other: str | None = None) -> Column:
    out = F.lit(values[-1] if other is None else other)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(n == i, F.lit(v)).otherwise(out)
    return out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    half = F.floor(n / 2)  # two documents share a folder and a name
    part = lambda k, p: F.concat(F.lit(p), (n % k).cast("string"))
    extension = _choice(n % 7, tuple(f".{e}" if e else "" for e in EXTENSIONS))
    name = F.concat(F.when(n % 50 == 3, ".").otherwise(""), F.lit("Report_"), half.cast("string"), extension)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("files:"), n.cast("string")).alias("document_id"),
        "doc_id",
        "source",
        F.concat_ws("/", _choice(half % 10, ROOTS, "Docs"), F.concat(F.lit("src"), (half % 20).cast("string")), name).alias("path"),
        _choice(n % 7, TYPES).alias("content_type"),
        F.col("text").alias("content"),
        F.md5("text").alias("content_hash"),
        "lang",
        "n_chars",
        F.date_add(F.lit("2015-01-01").cast("date"), (n % 3650).cast("int")).alias("document_date"),
        part(17, "user").alias("owner"),
        F.array(part(5, "user"), part(11, "user")).alias("users"),
        F.array(part(3, "group"), part(7, "group")).alias("groups"),
    )
