"""Scans, lookups, scopes, permissions and other filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalogue.registry import area
from lodestar.functions import paths
from lodestar.operators import filters
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()


@query("SELECT document_id, n_chars, content_hash FROM corpus")
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light projection; contents are hashed in the scan and not carried."""
    return corpus(spark, sf_dir).select("document_id", "n_chars", "content_hash")


@query("SELECT document_id, length(trim(content)) AS n FROM corpus WHERE length(trim(content)) > 0")
def scan_nonblank(spark, sf_dir):
    """S2."""
    return corpus(spark, sf_dir).where(F.length(F.trim("content")) > 0).select("document_id", F.length(F.trim("content")).cast("long").alias("n"))


@query("SELECT document_id, path FROM corpus WHERE (lower(path) LIKE 'docs/%' OR lower(path) LIKE 'archive/mail/%') AND NOT lower(path) LIKE 'docs/src3/%'")
def scan_path_scope(spark, sf_dir):
    """S3, F7, F11, C17."""
    return corpus(spark, sf_dir).where(paths.in_scope(F.col("path"), ["Docs", "Archive/Mail/"], ["Docs/src3"])).select("document_id", "path")


@query("""
SELECT w.pos, c.document_id, c.path FROM (SELECT unnest(generate_series(0, 9)) AS pos, 'files:' || unnest(generate_series(0, 9)) * 17 AS document_id) w
JOIN corpus c USING (document_id)""")
def lookup_ids(spark, sf_dir):
    """By id, in the order asked for."""
    wanted = spark.createDataFrame([(i, f"files:{i * 17}") for i in range(10)], "pos long, document_id string")
    return corpus(spark, sf_dir).join(F.broadcast(wanted), "document_id").select("pos", "document_id", "path")


@query("""
, r(ref) AS (VALUES ('files:12'), ('Docs/src3/Report_3.txt'), ('report_3.md'), ('Report_7'), ('missing.txt')),
m AS (
  SELECT ref, document_id, 1 AS tier FROM r JOIN corpus ON document_id = ref
  UNION ALL SELECT ref, document_id, 2 FROM r JOIN corpus ON lower(path) = lower(ref)
  UNION ALL SELECT ref, document_id, 3 FROM r JOIN corpus ON lower(regexp_extract(path, '([^/]*)$', 1)) = lower(ref) AND NOT contains(ref, '/')
), b AS (SELECT ref, min(tier) AS tier FROM m GROUP BY ref)
SELECT r.ref, b.tier, count(m.document_id) AS n, CASE WHEN count(m.document_id) = 1 THEN min(m.document_id) END AS document_id,
  CASE count(m.document_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM r LEFT JOIN b USING (ref) LEFT JOIN m ON m.ref = r.ref AND m.tier = b.tier GROUP BY r.ref, b.tier""")
def resolve_references(spark, sf_dir):
    """Id, then path, then base name; more than one match of the best kind is ambiguous."""
    refs = ["files:12", "Docs/src3/Report_3.txt", "report_3.md", "Report_7", "missing.txt"]
    r = F.broadcast(spark.createDataFrame([(x, x.lower()) for x in refs], "ref string, low string"))
    docs = corpus(spark, sf_dir).select("document_id", "path", F.lower("path").alias("low_path"), F.lower(paths.filename(F.col("path"))).alias("low_name"))
    ways = [
        (docs.join(r, F.col("document_id") == F.col("ref")), 1),
        (docs.join(r, F.col("low_path") == F.col("low")), 2),
        (docs.join(r, (F.col("low_name") == F.col("low")) & ~F.contains("ref", F.lit("/"))), 3),
    ]
    found = None
    for matched, tier in ways:
        part = matched.select("ref", "document_id", F.lit(tier).alias("tier"))
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("best", F.min("tier").over(Window.partitionBy("ref"))).where("tier = best")
    n = F.count("document_id")
    out = r.select("ref").join(best, "ref", "left").groupBy("ref", "tier").agg(n.alias("n"), F.min("document_id").alias("one"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return out.select("ref", "tier", "n", F.when(F.col("n") == 1, F.col("one")).alias("document_id"), status.alias("status"))


@query("""
SELECT document_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS filename,
  lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) AS extension, CAST(regexp_extract(document_id, '^files:([0-9]+)$', 1) AS BIGINT) AS openfile_id FROM corpus""".replace("\\\\", "\\"))
def path_metadata(spark, sf_dir):
    """F1, F2."""
    p = F.col("path")
    number = F.regexp_extract("document_id", "^files:([0-9]+)$", 1).cast("long")
    return corpus(spark, sf_dir).select("document_id", paths.directory(p).alias("directory"), paths.filename(p).alias("filename"), paths.extension(p).alias("extension"), number.alias("openfile_id"))


_ORIGIN = """
o AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'mail_archive' WHEN regexp_extract(path, '([^/]*)$', 1) LIKE '.%' THEN 'machine_metadata' WHEN path LIKE 'Archive/Web/%' THEN 'web_archive'
  WHEN path LIKE 'Archive/Chats/%' THEN 'chat_archive' WHEN path LIKE 'Archive/Mail/%' THEN 'mail_archive' ELSE 'internal' END AS origin FROM corpus)
"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its origin; the registry (here every 23rd document) wins over the path."""
    docs = corpus(spark, sf_dir)
    registry = docs.where("doc_id % 23 = 0").select("document_id", F.lit("mail_archive").alias("registered"))
    return docs.join(registry, "document_id", "left").withColumn("origin", paths.origin(F.col("path"), F.col("registered")))


@query(f"WITH {CORPUS}, {_ORIGIN} SELECT origin, count(*) AS n FROM o GROUP BY origin")
def origin_counts(spark, sf_dir):
    """F6, F8, J8, J9."""
    return classified(spark, sf_dir).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CORPUS}, {_ORIGIN}, h AS (SELECT * FROM o WHERE regexp_extract(path, '([^/]*)$', 1) NOT LIKE '.%')
SELECT 'default' AS scope, document_id FROM h WHERE origin = 'internal' UNION ALL SELECT 'mail', document_id FROM h WHERE origin = 'mail_archive'
UNION ALL SELECT 'chat+documents', document_id FROM h WHERE origin IN ('chat_archive', 'web_archive', 'internal')""")
def scope_filter(spark, sf_dir):
    """F4, F5, F9, F10."""
    docs = classified(spark, sf_dir)
    chosen = {"default": None, "mail": ["mail"], "chat+documents": ["chat", "documents"]}
    allowed = F.array(*(F.when(paths.scope_allows(F.col("path"), F.col("origin"), s), F.lit(k)) for k, s in chosen.items()))
    return docs.select(F.explode(F.array_compact(allowed)).alias("scope"), "document_id")


@query("""
, e AS (SELECT document_id, path, content_type, content, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+[.]([^.]+)$', 1)) AS x FROM corpus)
SELECT document_id, CASE WHEN x IN ('eml','msg','zip','7z','rar','tar','gz') THEN 'excluded_extension:' || x
  WHEN x NOT IN ('txt','md','pdf','odt','ods','odp','doc','docx','rtf','html','csv') AND content_type IN ('message/rfc822','application/zip','application/x-7z-compressed') THEN 'excluded_mime:' || content_type
  WHEN length(trim(content)) < 500 THEN 'text_too_short' ELSE 'allowed' END AS reason FROM e""")
def index_eligibility(spark, sf_dir):
    """F12."""
    return corpus(spark, sf_dir).select("document_id", filters.eligibility(F.col("path"), F.col("content_type"), F.col("content"), 500).alias("reason"))


@query("SELECT document_id FROM corpus WHERE owner = 'user3' OR list_contains(users, 'user3') OR list_has_any(groups, ['group2', 'group5'])")
def acl_prefilter(spark, sf_dir):
    """F13, F14."""
    return corpus(spark, sf_dir).where(filters.may_read("user3", ["group2", "group5"])).select("document_id")


@query("SELECT document_id FROM corpus WHERE owner = 'user3' OR list_contains(users, 'user3')")
def acl_without_groups(spark, sf_dir):
    """F13 with an empty group list, which still is a list."""
    return corpus(spark, sf_dir).where(filters.may_read("user3", [])).select("document_id")


@query("SELECT document_id, CAST(document_date AS VARCHAR) AS document_date FROM corpus WHERE document_date BETWEEN DATE '2016-03-01' AND DATE '2018-02-28'")
def date_range(spark, sf_dir):
    """both ends count."""
    return corpus(spark, sf_dir).where(F.col("document_date").between("2016-03-01", "2018-02-28")).select("document_id", F.col("document_date").cast("string"))


@query(r"""SELECT document_id, n, h FROM (SELECT document_id,
  length(content) - length(regexp_replace(content, '(?i)(?:token|secret|password|api_key|apikey)\s*[=:]\s*["'']?[A-Za-z0-9._~+/-]{12,}["'']?', '', 'g')) > 0 AS has,
  len(regexp_extract_all(content, '(?i)(?:token|secret|password|api_key|apikey)\s*[=:]\s*["'']?[A-Za-z0-9._~+/-]{12,}["'']?')) + len(regexp_extract_all(content, 'AKIA[0-9A-Z]{16}')) AS n,
  md5(regexp_replace(regexp_replace(regexp_replace(content, '(?i)bearer\s+[A-Za-z0-9._~+/-]{16,}', '[REDACTED]', 'g'), '(?i)(?:token|secret|password|api_key|apikey)\s*[=:]\s*["'']?[A-Za-z0-9._~+/-]{12,}["'']?', '[REDACTED]', 'g'), 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g')) AS h FROM corpus) WHERE n > 0""")
def redact_secrets(spark, sf_dir):
    """F43."""
    text, n = filters.redacted(F.col("content"))
    return corpus(spark, sf_dir).select("document_id", n.cast("long").alias("n"), F.md5(text).alias("h")).where("n > 0")


@query(r"""SELECT item_id AS query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' 2019 INV-2020-17 2019 3.4.2021', '\b((?:19|20)[0-9]{2})\b', 1))), ',') AS years,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' 2019 INV-2020-17 2019 3.4.2021', '\b([A-Z]{2,}[-/][0-9]{2,}[-/0-9A-Z]*)\b', 1))), ',') AS identifiers FROM benchmark""")
def question_constraints(spark, sf_dir):
    """F21, F22."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), filters.hard_constraints(F.concat("text", F.lit(" 2019 INV-2020-17 2019 3.4.2021"))).alias("c"))
    return asked.select("query_id", F.array_join(F.array_sort("c.years"), ",").alias("years"), F.array_join(F.array_sort("c.identifiers"), ",").alias("identifiers"))


@query("""
, w(query_id, value) AS (VALUES (1, '19'), (1, 'the'), (2, 'zzzzzz'), (3, '@mail')), q AS (SELECT DISTINCT query_id FROM w),
t AS (SELECT query_id, document_id, (SELECT bool_and(contains(content, value)) FROM w WHERE w.query_id = q.query_id) AS holds FROM q, corpus),
s AS (SELECT query_id, bool_or(holds) AS fits FROM t GROUP BY query_id)
SELECT query_id, document_id FROM t JOIN s USING (query_id) WHERE holds OR NOT fits""")
def constraint_recall(spark, sf_dir):
    """all values of a query, fails open."""
    wanted = spark.createDataFrame([(1, "19"), (1, "the"), (2, "zzzzzz"), (3, "@mail")], "query_id int, value string")
    asked = F.broadcast(wanted.select("query_id").distinct())
    candidates = corpus(spark, sf_dir).select("document_id", "content").crossJoin(asked)
    return filters.satisfying(candidates, wanted).select("query_id", "document_id")
