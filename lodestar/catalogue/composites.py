"""Whole retrievals and remaining compositions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalogue.knowledge import _OBS, observations
from lodestar.catalogue.registry import area
from lodestar.catalogue.retrieval import _ARMS, _BM25, _CURVE, arms, lexical_hits
from lodestar.functions import text
from lodestar.operators.filters import may_read
from lodestar.plans import search
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()


@query(f"""WITH {_ARMS}, {_CURVE}, b AS (SELECT query_id, max(CASE WHEN arm = 'files' THEN signal END) AS x, coalesce(bool_or(arm = 'files' AND n >= 8), FALSE) AS rx, max(CASE WHEN arm = 'vector' THEN signal END) AS y, coalesce(bool_or(arm = 'vector' AND n >= 8), FALSE) AS ry FROM sig GROUP BY 1),
c AS (SELECT *, rx AND x < 0.08 AS wx, ry AND y < 0.08 AS wy, x >= y * 1.5 AND x - y >= 0.1 AS bx, y >= x * 1.5 AND y - x >= 0.1 AS byy FROM b),
p AS (SELECT query_id, CASE WHEN y IS NULL AND wx OR x IS NULL AND wy OR wx AND wy THEN 'unspecific' WHEN y IS NULL THEN 'lexical' WHEN x IS NULL THEN 'vector' WHEN wx THEN 'vector' WHEN wy THEN 'lexical' WHEN bx THEN 'lexical' WHEN byy THEN 'vector' ELSE 'fusion' END AS mode,
  CASE WHEN y IS NULL THEN 1.0 WHEN x IS NULL THEN 0.0 WHEN wx THEN 0.2 WHEN wy OR bx THEN 1.0 WHEN byy THEN greatest(0.2, least(1.0, x / greatest(y, 1e-9))) ELSE 1.0 END AS lw,
  CASE WHEN y IS NULL THEN 0.0 WHEN x IS NULL THEN 1.0 WHEN wx THEN 1.0 WHEN wy THEN 0.2 WHEN bx THEN greatest(0.2, least(1.0, y / greatest(x, 1e-9))) ELSE 1.0 END AS vw FROM c),
f AS (SELECT query_id, mode, document_id, round(sum(round(CASE WHEN arm = 'files' THEN lw ELSE vw END, 6) / (60 + rank)), 9) AS rrf, min(CASE WHEN arm = 'files' THEN rank END) AS fr, min(CASE WHEN arm = 'vector' THEN rank END) AS vr FROM arm JOIN p USING (query_id) WHERE mode <> 'unspecific' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fr NULLS LAST, vr NULLS LAST, document_id) AS k FROM f QUALIFY k <= 10)
SELECT query_id, mode, document_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM r JOIN corpus USING (document_id) WHERE owner = 'user3' OR list_contains(users, 'user3') OR list_has_any(groups, ['group2', 'group5'])""")
def search_batch(spark, sf_dir):
    """Arms, signals, strategy, fusion, limit and authorization in one job for all queries."""
    allowed = corpus(spark, sf_dir).where(may_read("user3", ["group2", "group5"])).select("document_id")
    return search.fused_search(arms(spark, sf_dir), allowed, 10).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH p AS (SELECT page_id % 4 AS batch, url, length(html) AS score FROM pages), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY batch ORDER BY score DESC, url) <= 10)
SELECT url, max(score) AS score, count(*) AS batches FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def page_selection(spark, sf_dir):
    """The best pages of each batch of hits, then of all."""
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("batch"), "url", F.length("html").cast("long").alias("score"))
    return search.select_per_batch(p, 10, 15)


@query("""SELECT conv_id, turn, CAST(json_extract_string(regexp_extract(text || ' {"score": ' || turn || '} tail', '(?s)(\\{.*\\})', 1), '$.score') AS INTEGER) AS score FROM conversations WHERE NOT contains(text, '{') AND NOT contains(text, '}')""".replace("\\\\", "\\"))
def json_salvage(spark, sf_dir):
    """X47."""
    c = table(spark, sf_dir, "conversations").where("not contains(text, '{') and not contains(text, '}')")
    raw = F.concat("text", F.lit(' {"score": '), F.col("turn").cast("string"), F.lit("} tail"))
    return c.select("conv_id", "turn", F.from_json(text.json_payload(raw), "score int")["score"].alias("score"))


@query(f"""WITH {_BM25} SELECT query_id, document_id, path || ' | ' || CAST(document_date AS VARCHAR) || ' | ' || substr(content, 1, 1400) AS body FROM lex JOIN corpus USING (document_id)""")
def rerank_texts(spark, sf_dir):
    """What a reranker reads: path, date and text."""
    d = corpus(spark, sf_dir).select("document_id", F.concat_ws(" | ", "path", F.col("document_date").cast("string"), F.substring("content", 1, 1400)).alias("body"))
    return lexical_hits(spark, sf_dir).select("query_id", "document_id").join(d, "document_id").select("query_id", "document_id", "body")


@query(r"""SELECT document_id, regexp_replace(substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 80), '(the|der|la)', '**\1**', 'g') AS shown FROM corpus""")
def highlighted(spark, sf_dir):
    """X46."""
    short = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, 80)
    return corpus(spark, sf_dir).select("document_id", F.regexp_replace(short, "(the|der|la)", "**$1**").alias("shown"))


@query("""WITH e AS (SELECT s_suppkey, s_nationkey FROM supplier), x AS (SELECT c_custkey, c_nationkey FROM customer)
SELECT s_suppkey AS candidate, count(*) AS links FROM e JOIN x ON s_nationkey = c_nationkey GROUP BY 1""")
def context_links(spark, sf_dir):
    """Candidates and context entities that share a place, by the number of its context entities."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    n = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("links"))
    return s.join(n, "s_nationkey").select(F.col("s_suppkey").alias("candidate"), "links")


@query("""WITH f AS (SELECT p_partkey AS id, p_brand || ':' || p_size || ':' || p_type AS form, p_name FROM part)
SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.form = b.form AND a.id < b.id WHERE a.p_name <> b.p_name""")
def possible_same_as(spark, sf_dir):
    """Candidates by a shared form, minus pairs that are settled already (here: of one name)."""
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(":", "p_brand", "p_size", "p_type").alias("form"), "p_name")
    a, b = f.select(F.col("id").alias("a"), "form", F.col("p_name").alias("x")), f.select(F.col("id").alias("b"), "form", F.col("p_name").alias("y"))
    pairs = a.join(b, "form").where("a < b")
    settled = f.select(F.col("id").alias("a"), F.col("p_name").alias("x"))
    return pairs.join(settled, ["a", "x"], "left_semi").where("x <> y").select("a", "b")


@query(f"""WITH {CORPUS}, s AS (SELECT document_id, regexp_replace(path, '/([^/]*)$', '/.\\1.meta.json') AS sidecar FROM corpus WHERE doc_id % 4 = 0)
SELECT c.document_id, s.sidecar FROM corpus c JOIN s ON regexp_replace(c.path, '/([^/]*)$', '/.\\1.meta.json') = s.sidecar""".replace("\\\\", "\\"))
def sidecar_documents(spark, sf_dir):
    """Sidecar files and the documents beside them."""
    name = F.regexp_replace("path", "/([^/]*)$", "/.$1.meta.json")
    d = corpus(spark, sf_dir)
    s = d.where("doc_id % 4 = 0").select(name.alias("sidecar"))
    return d.select("document_id", name.alias("sidecar")).join(s, "sidecar").select("document_id", "sidecar")


@query(f"WITH {_OBS} SELECT document_id, subject || ' supplies ' || object AS relation FROM obs")
def relation_texts(spark, sf_dir):
    """Relations as sentences."""
    words = F.create_map(F.lit("SUPPLIES"), F.lit("supplies"))
    return observations(spark, sf_dir).select("document_id", F.concat_ws(" ", "subject", words[F.col("predicate")], "object").alias("relation"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)
SELECT c_nationkey AS root, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY k) AS best FROM r WHERE k <= 3 GROUP BY 1""")
def nested_profiles(spark, sf_dir):
    """C14: the best members of each group as a list."""
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(order)).where("k <= 3")
    return r.groupBy(F.col("c_nationkey").alias("root")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c_custkey"))), lambda s: s["c_custkey"].cast("string")), ",").alias("best"))
