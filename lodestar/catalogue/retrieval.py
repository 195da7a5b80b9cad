"""Lexical and vector arms, their signals and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalogue.registry import area
from lodestar.operators import fusion, lexical, vector
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()
TOP = 20

_TOKENS = r"""
tok AS (SELECT document_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM corpus)
"""
_BM25 = rf"""{CORPUS}, {_TOKENS},
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
ex AS (SELECT document_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT document_id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok),
hit AS (SELECT query_id, document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, count(*) AS matched
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY query_id, document_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM hit QUALIFY rank <= {TOP})
"""
_VEC = f"""
v AS (SELECT vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
vs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk, 'files:' || (c.vec_id // 3) AS document_id,
  round(list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (c.n * q.n), 6) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM vs QUALIFY rank <= 30),
vd AS (SELECT query_id, document_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM
  (SELECT query_id, document_id, chunk, score, rank AS r, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS k FROM vt WHERE score >= 0.1) WHERE k = 1)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best TOP of each question; while they are few they go to the texts that join them, not the texts to them."""
    questions = asked(spark, sf_dir)
    hits = lexical.top_k(lexical.bm25(corpus(spark, sf_dir), lexical.query_terms(questions)), TOP, "query_id")
    return lexical.if_small(hits, questions, lexical.SMALL // TOP)


def vector_hits(spark: SparkSession, sf_dir: str, threshold: float | None = 0.1) -> DataFrame:
    """The query vectors are the stored rows whose id is divisible by 100, against all rows."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.concat(F.lit("files:"), F.floor(F.col("vec_id") / 3).cast("string")).alias("document_id"), "embedding")
    queries = stored.where("chunk % 100 = 0").select(F.col("chunk").alias("query_id"), "embedding")
    return vector.cosine_top_k(stored, queries, 30, threshold)


@query(f"WITH {_BM25} SELECT query_id, document_id, score, rank FROM lex")
def lexical_topk(spark, sf_dir):
    """Every benchmark item is a query."""
    return lexical_hits(spark, sf_dir).select("query_id", "document_id", "score", F.col("rank").cast("long"))


@query(f"WITH {_BM25}, s AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1) SELECT query_id, count(*) AS n, max(score) AS top FROM hit JOIN s USING (query_id) WHERE matched >= greatest(floor(asked * 0.25), 1) GROUP BY 1")
def lexical_min_should_match(spark, sf_dir):
    """Hits that hold a quarter of the terms, with the true total."""
    terms = lexical.query_terms(asked(spark, sf_dir))
    kept = lexical.enough(lexical.bm25(corpus(spark, sf_dir), terms), terms, 0.25)
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


@query(f"WITH {CORPUS}, {_TOKENS} SELECT document_id FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def phrase_search(spark, sf_dir):
    """L3: adjacent words."""
    return corpus(spark, sf_dir).where(lexical.phrase(F.col("content"), ["of", "the"])).select("document_id")


@query(f"WITH {CORPUS}, {_TOKENS} SELECT document_id FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the')")
def phrase_prefix_search(spark, sf_dir):
    """L4: the last word may go on."""
    return corpus(spark, sf_dir).where(lexical.phrase(F.col("content"), ["of", "the"], prefix=True)).select("document_id")


@query(f"""WITH {CORPUS}, {_TOKENS}, p AS (SELECT document_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tok)
SELECT a.document_id, count(DISTINCT a.pos) AS occurrences FROM p a JOIN p b ON a.document_id = b.document_id AND b.pos - a.pos BETWEEN 1 AND 3 WHERE a.term = 'in' AND b.term = 'the' GROUP BY 1""")
def sloppy_phrase(spark, sf_dir):
    """L4: up to two words between."""
    return lexical.sloppy(corpus(spark, sf_dir), "in", "the", 2)


@query(f"WITH {CORPUS}, {_TOKENS} SELECT document_id, len(list_intersect(list_distinct(w), ['as', 'with'])) AS optional FROM tok WHERE list_has_all(w, ['the', 'of']) AND NOT list_contains(w, 'this')")
def boolean_search(spark, sf_dir):
    """L7, L12."""
    return lexical.boolean(corpus(spark, sf_dir), ["the", "of"], ["as", "with"], ["this"]).select("document_id", F.col("optional").cast("long"))


@query(f"""WITH {_BM25}, part AS (SELECT query_id, document_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM tf JOIN df USING (term) JOIN q USING (term), st),
g AS (SELECT query_id, document_id, length(term) % 3 AS concept, max(s) AS s FROM part GROUP BY ALL)
SELECT query_id, document_id, round(sum(s), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 6) DESC, document_id) AS rank FROM g GROUP BY query_id, document_id QUALIFY rank <= 10""")
def concept_groups(spark, sf_dir):
    """Of the variants of a concept (here terms of like length) only the best counts."""
    terms = lexical.query_terms(asked(spark, sf_dir)).withColumn("concept", F.length("term") % 3)
    docs = corpus(spark, sf_dir)
    single = terms.select(F.struct("query_id", "concept", "term").alias("query_id"), "term")
    each = lexical.bm25_parts(docs, single, lexical.parts(docs, terms, "query_id", "concept"))
    best = each.groupBy("query_id.query_id", "query_id.concept", "document_id").agg(F.max("part").alias("part"))
    scored = best.groupBy("query_id", "document_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return lexical.top_k(scored, 10, "query_id").select("query_id", "document_id", "score", F.col("rank").cast("long"))


_SYNTAX = """w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS v FROM benchmark), s AS (SELECT query_id, v FROM w WHERE len(v) >= 5)"""


@query(f"""WITH {_SYNTAX}, t AS (SELECT query_id, unnest([{{'pos': 0, 'sign': '+', 'kind': 'word', 'value': v[1]}}, {{'pos': 1, 'sign': '', 'kind': 'phrase', 'value': v[2] || ' ' || v[3]}}, {{'pos': 2, 'sign': '-', 'kind': 'word', 'value': v[4]}}, {{'pos': 3, 'sign': '', 'kind': 'word', 'value': v[5]}}]) AS t FROM s)
SELECT query_id, t.pos AS pos, t.sign AS sign, t.kind AS kind, t.value AS value FROM t""")
def query_syntax(spark, sf_dir):
    """Queries with signs, typographic quotes and phrases, made of the words of each benchmark text."""
    v = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    w = lambda i: F.get("v", F.lit(i))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), v.alias("v")).where(F.size("v") >= 5)
    q = q.select("query_id", F.concat(F.lit("+"), w(0), F.lit(" „"), w(1), F.lit(" "), w(2), F.lit("” -"), w(3), F.lit("  "), w(4)).alias("text"))
    return q.select("query_id", F.posexplode(lexical.query_tokens(F.col("text"))).alias("pos", "t")).select("query_id", "pos", "t.sign", "t.kind", "t.value")


@query("""SELECT document_id, substr(content, greatest(coalesce(list_min(list_filter([strpos(lower(content), 'tion'), strpos(lower(content), 'ment')], lambda x: x > 0)), 1) - 60, 1), 120) AS snippet FROM corpus""")
def snippets(spark, sf_dir):
    """L14."""
    terms = F.array(F.lit("tion"), F.lit("ment"))
    return corpus(spark, sf_dir).select("document_id", lexical.snippet(F.col("content"), terms).alias("snippet"))


@query(f"WITH {_VEC} SELECT query_id, chunk, document_id, score, rank FROM vt")
def vector_topk(spark, sf_dir):
    """T1."""
    return vector_hits(spark, sf_dir, None).select("query_id", "chunk", "document_id", "score", F.col("rank").cast("long"))


@query(f"WITH {_VEC} SELECT query_id, document_id, chunk, score, rank FROM vd")
def vector_documents(spark, sf_dir):
    """Limit, then threshold, then the best chunk of each document."""
    return vector.best_chunk(vector_hits(spark, sf_dir)).select("query_id", "document_id", "chunk", "score", F.col("rank").cast("long"))


_ARMS = f"""{_BM25}, {_VEC}, arm AS (SELECT query_id, 'files' AS arm, document_id, rank, 1.0 AS w, score FROM lex UNION ALL SELECT query_id // 100, 'vector', document_id, rank, 0.7, score FROM vd)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms of the queries; a query's vector is the stored row of its number times 100."""
    lex = lexical_hits(spark, sf_dir).select("query_id", F.lit("files").alias("arm"), "document_id", "rank", F.lit(1.0).alias("weight"), "score")
    vec = vector.best_chunk(vector_hits(spark, sf_dir)).select(F.floor(F.col("query_id") / 100).alias("query_id"), F.lit("vector").alias("arm"), "document_id", "rank", F.lit(0.7).alias("weight"), "score")
    return lex.unionByName(vec)


@query(f"""WITH {_ARMS}, f AS (SELECT query_id, document_id, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 9) AS rrf, min(CASE WHEN arm = 'files' THEN rank END) AS fr, min(CASE WHEN arm = 'vector' THEN rank END) AS vr, count(DISTINCT arm) AS n_arms FROM arm GROUP BY ALL)
SELECT query_id, document_id, rrf, n_arms, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fr NULLS LAST, vr NULLS LAST, document_id) AS rank FROM f""")
def weighted_rrf(spark, sf_dir):
    """A1, A3, J1, J2, T4."""
    return fusion.weighted_rrf(arms(spark, sf_dir)).select("query_id", "document_id", "rrf", F.size("arms").cast("long").alias("n_arms"), F.col("rank").cast("long"))


@query(f"""WITH {_ARMS}, p AS (SELECT query_id % 10 AS query_id, query_id AS probe, document_id, min(rank) AS rank FROM arm GROUP BY ALL)
SELECT query_id, document_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS probes, min(rank) AS best_rank FROM p GROUP BY ALL""")
def probe_rrf(spark, sf_dir):
    """A2: ten questions with several probes each."""
    hits = arms(spark, sf_dir).select((F.col("query_id") % 10).alias("query_id"), F.col("query_id").alias("probe"), "document_id", "rank")
    return fusion.probe_rrf(hits).withColumn("best_rank", F.col("best_rank").cast("long"))


_CURVE = """
l AS (SELECT query_id, arm, list_sort(list(CAST(score AS DOUBLE)), 'DESC') AS s FROM arm GROUP BY ALL),
t AS (SELECT *, len(s) AS n, greatest(abs(s[1]), 1e-9) AS d, list_avg(s[1:3]) AS hm, list_median(s[len(s) - least(len(s), greatest(1, CAST(ceil(len(s) * 0.33) AS BIGINT))) + 1:]) AS tm FROM l),
dr AS (SELECT *, list_transform(range(1, n), lambda i: greatest((s[i] - s[i + 1]) / d, 0.0)) AS drops FROM t),
sg AS (SELECT query_id, arm, n, hm, tm, coalesce(list_max(drops), 0.0) AS elbow, CASE WHEN n >= 2 THEN list_position(drops, list_max(drops)) END AS elbow_rank,
  least(greatest(0.55 * greatest((hm - tm) / d, 0) + 0.25 * greatest((s[1] - tm) / d, 0) + 0.2 * coalesce(list_max(drops), 0.0), 0), 1) AS raw FROM dr),
sig AS (SELECT *, CASE WHEN n < 8 THEN greatest(raw, 0.35) ELSE raw END AS signal FROM sg)
"""


@query(f"WITH {_ARMS}, {_CURVE} SELECT query_id, arm, n, round(hm, 6) AS head_mean, round(tm, 6) AS tail_median, round(elbow, 6) AS elbow, elbow_rank, round(signal, 6) AS signal FROM sig")
def score_curve(spark, sf_dir):
    """A4, W6."""
    c = fusion.curve_profile(arms(spark, sf_dir), "query_id", "arm")
    r = lambda x, name=None: F.round(x, 6).alias(name or x)
    return c.select("query_id", "arm", F.col("count").cast("long").alias("n"), r("head_mean"), r("tail_median"), r("elbow_strength", "elbow"), "elbow_rank", r("signal"))


@query(f"""WITH {_ARMS}, {_CURVE}, b AS (SELECT query_id, max(CASE WHEN arm = 'files' THEN signal END) AS x, bool_or(arm = 'files' AND n >= 8) AS rx, max(CASE WHEN arm = 'vector' THEN signal END) AS y, bool_or(arm = 'vector' AND n >= 8) AS ry FROM sig GROUP BY 1),
c AS (SELECT *, rx AND x < 0.08 AS wx, ry AND y < 0.08 AS wy FROM b)
SELECT query_id, CASE WHEN y IS NULL AND wx OR x IS NULL AND wy OR wx AND wy THEN 'unspecific' WHEN y IS NULL THEN 'lexical' WHEN x IS NULL THEN 'vector' WHEN wx THEN 'vector' WHEN wy THEN 'lexical'
  WHEN x >= y * 1.5 AND x - y >= 0.1 THEN 'lexical' WHEN y >= x * 1.5 AND y - x >= 0.1 THEN 'vector' ELSE 'fusion' END AS strategy FROM c""")
def strategy_choice(spark, sf_dir):
    """A6."""
    c = fusion.curve_profile(arms(spark, sf_dir), "query_id", "arm")
    of = lambda arm, v: F.max(F.when(F.col("arm") == arm, F.col(v)))
    b = c.groupBy("query_id").agg(of("files", "signal").alias("x"), of("files", "reliable").alias("rx"), of("vector", "signal").alias("y"), of("vector", "reliable").alias("ry"))
    s = fusion.strategy(F.col("x"), F.coalesce("rx", F.lit(False)), F.col("y"), F.coalesce("ry", F.lit(False)))
    return b.select("query_id", s["strategy"].alias("strategy"))


@query(f"""WITH {_ARMS}, a AS (SELECT query_id, list(document_id) AS x FROM arm WHERE arm = 'files' AND rank <= 10 GROUP BY 1), b AS (SELECT query_id, list(document_id) AS y FROM arm WHERE arm = 'vector' AND rank <= 10 GROUP BY 1)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(len(list_intersect(x, y)), 0) AS common, coalesce(round(len(list_intersect(x, y)) / least(len(x), len(y)), 6), 0) AS ratio FROM a FULL JOIN b ON a.query_id = b.query_id""")
def overlap_at_k(spark, sf_dir):
    """A5."""
    hits = arms(spark, sf_dir)
    return fusion.overlap_at_k(hits.where("arm = 'files'"), hits.where("arm = 'vector'"), 10).withColumn("common", F.col("common").cast("long"))


@query(f"""WITH {_ARMS}, f AS (SELECT query_id, document_id, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 9) AS rrf, min(CASE WHEN arm = 'files' THEN rank END) AS fr, min(CASE WHEN arm = 'vector' THEN rank END) AS vr, bool_or(rank <= 3) AS head FROM arm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fr NULLS LAST, vr NULLS LAST, document_id) AS rank FROM f)
SELECT query_id, document_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, rank) AS place FROM r QUALIFY place <= 15""")
def candidate_pool(spark, sf_dir):
    """The heads of each arm are admitted first."""
    hits = arms(spark, sf_dir)
    return fusion.admit(fusion.weighted_rrf(hits), hits, 3, 15).select("query_id", "document_id", F.col("rank").cast("long"), F.col("place").cast("long"))


@query(f"""WITH {_BM25}, l AS (SELECT query_id, document_id, rank, rank % 7 = 0 AS required FROM lex),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY required DESC, rank) AS m FROM l QUALIFY m <= 8)
SELECT query_id, document_id, required, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM m""")
def required_results(spark, sf_dir):
    """Every seventh hit is mandatory."""
    hits = lexical_hits(spark, sf_dir).withColumn("required", F.col("rank") % 7 == 0)
    return fusion.keep_required(hits, 8).select("query_id", "document_id", "required", F.col("rank").cast("long"))


@query(f"""WITH {_BM25}, a AS (SELECT query_id, document_id, 1 AS stage, score FROM lex WHERE rank <= 5), b AS (SELECT query_id, document_id, 2 AS stage, score FROM lex WHERE rank <= 12 AND (query_id, document_id) NOT IN (SELECT query_id, document_id FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def staged_expansion(spark, sf_dir):
    """The expansion adds what the primary stage didn't find."""
    hits = lexical_hits(spark, sf_dir)
    first, more = hits.where("rank <= 5"), hits.where("rank <= 12")
    added = more.join(first, ["query_id", "document_id"], "left_anti")
    pick = lambda d, n: d.select("query_id", "document_id", F.lit(n).alias("stage"), "score")
    return pick(first, 1).unionByName(pick(added, 2))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, document_id, rank FROM lex WHERE rank <= 10)
SELECT query_id, rank, document_id, path, length(content) AS n FROM r LEFT JOIN corpus USING (document_id)""")
def hydrate(spark, sf_dir):
    """Texts join only the final rows."""
    hits = lexical_hits(spark, sf_dir).where("rank <= 10").select("query_id", F.col("rank").cast("long"), "document_id")
    docs = corpus(spark, sf_dir).select("document_id", "path", F.length("content").cast("long").alias("n"))
    return hits.join(docs, "document_id", "left").select("query_id", "rank", "document_id", "path", "n")


@query(f"""WITH {_BM25} SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lex JOIN corpus USING (document_id) WHERE owner = 'user3' OR list_contains(users, 'user3') OR list_has_any(groups, ['group2', 'group5'])""")
def authorized_results(spark, sf_dir):
    """Denied hits go and aren't refilled; ranks close up."""
    from pyspark.sql.window import Window

    from lodestar.operators.filters import may_read

    visible = corpus(spark, sf_dir).where(may_read("user3", ["group2", "group5"])).select("document_id")
    kept = lexical_hits(spark, sf_dir).join(visible, "document_id", "left_semi")
    return kept.select("query_id", "document_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long").alias("rank"))
