"""Plans of questions over the tables: entities, phrases, arms, budgets and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalogue.registry import area
from lodestar.catalogue.retrieval import _BM25, lexical_hits
from lodestar.operators import lexical
from lodestar.plans import planner
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()

_PEOPLE = """p AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 3 = 0 AS two FROM supplier),
a AS (SELECT id, name, two, CASE id % 6 WHEN 0 THEN 'Was gibt es zu ' || name WHEN 1 THEN 'zeige mir alle Dokumente von ' || name || ' aus 2020' WHEN 2 THEN 'suche Rechnungen zu ' || name
  WHEN 3 THEN 'Welche Beziehung besteht zwischen ' || name || ' und anderen' WHEN 4 THEN name ELSE 'Infos zu ' || upper(name) || ' vom 3.4.' END AS text FROM p)"""


def people(spark, sf_dir):
    """Questions about suppliers: (id, name, text, statuses of the entities found in them)."""
    i, n, lit = F.col("s_suppkey"), F.col("s_name"), F.lit
    asked = [
        F.concat(lit("Was gibt es zu "), n), F.concat(lit("zeige mir alle Dokumente von "), n, lit(" aus 2020")), F.concat(lit("suche Rechnungen zu "), n),
        F.concat(lit("Welche Beziehung besteht zwischen "), n, lit(" und anderen")), n, F.concat(lit("Infos zu "), F.upper(n), lit(" vom 3.4.")),
    ]
    statuses = F.when(i % 3 == 0, F.array(lit("resolved"), lit("ambiguous"))).otherwise(F.array(lit("resolved"), lit("unknown")))
    return table(spark, sf_dir, "supplier").select(i.alias("id"), n.alias("name"), F.element_at(F.array(*asked), (i % 6).cast("int") + 1).alias("text"), statuses.alias("statuses"), F.when(i % 3 == 0, 2).otherwise(1).alias("resolved"))


@query(f"WITH {_PEOPLE} SELECT id, NOT two AND id % 6 IN (0, 4) AS broad, two AND id % 6 = 3 AS relation, NOT two AS recall FROM a")
def entity_questions(spark, sf_dir):
    """questions about one entity only, about a relation, and those whose recall may be widened."""
    q = people(spark, sf_dir)
    relation = planner.relation_question(F.col("text"), F.col("statuses"))
    return q.select("id", planner.broad_entity(F.col("text"), F.col("name"), F.col("resolved")).alias("broad"), relation.alias("relation"), (~relation & (planner.usable(F.col("statuses")) == 1)).alias("recall"))


@query("""WITH e AS (SELECT event_id, list_filter(['files', 'vector', 'graph'], lambda x, i: (event_id // (CAST(1 AS BIGINT) << (i - 1))) % 2 = 1) AS requested,
  list_filter(['files', 'vector', 'graph'], lambda x, i: (event_id // (CAST(8 AS BIGINT) << (i - 1))) % 2 = 1) AS available FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(['files', 'graph', 'vector'], lambda x: list_contains(available, x) AND (x = 'files' OR event_id % 11 = 0 OR list_contains(requested, x)))), ',') AS arms FROM e""")
def arm_sets(spark, sf_dir):
    """Required arms, and the optional ones that were asked for and are there."""
    names = F.array(F.lit("files"), F.lit("vector"), F.lit("graph"))
    bits = lambda first: F.filter(names, lambda x, i: F.shiftright("event_id", 0).bitwiseAND(F.shiftleft(F.lit(first), 0).cast("long") * F.pow(F.lit(2), i).cast("long")) != 0)
    e = table(spark, sf_dir, "events")
    requested = F.when(F.col("event_id") % 11 != 0, bits(1))
    chosen = planner.arms(F.array(F.lit("files")), F.array(F.lit("vector"), F.lit("graph")), requested, bits(8))
    return e.select("event_id", F.array_join(chosen, ",").alias("arms"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS d, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v FROM benchmark),
u AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY -length(t), list_position(v, t)) AS k FROM (SELECT item_id, v, unnest(d) AS t FROM w))
SELECT item_id, string_agg(t, ' ' ORDER BY k) AS terms FROM u WHERE k <= 12 GROUP BY 1""")
def longest_terms(spark, sf_dir):
    """The twelve longest terms of each text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(planner.longest_terms(lexical.words(F.col("text"))), " ").alias("terms")).where("terms <> ''")


@query(r"""WITH w AS (SELECT item_id, string_split(text, ' ')[1:3] AS e, regexp_extract_all(text, '[a-z]{8,}') AS c, regexp_extract_all(text, '[0-9]{4}') AS y FROM benchmark)
SELECT item_id, len(list_filter(e, lambda x: trim(x) <> '')) AS n, array_to_string(list_filter(list_transform(e, lambda x, i: CASE WHEN trim(x) <> '' THEN 'q' || i || '=' || x END), lambda x: x IS NOT NULL), ';') AS entities, array_to_string(y, ',') AS constraints, array_to_string(c, ',') AS concepts FROM w""")
def spec_frames(spark, sf_dir):
    """Query frames of specifications that name the first words as entities, years as constraints and long words as concepts."""
    b = table(spark, sf_dir, "benchmark")
    all_ = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    f = b.select("item_id", planner.spec_frame(F.lit(""), F.slice(F.split("text", " "), 1, 3), all_("[0-9]{4}"), all_("[a-z]{8,}")).alias("f"))
    shown = F.array_join(F.transform("f.entities", lambda e: F.concat(e["id"], F.lit("="), e["text"])), ";")
    return f.select("item_id", F.size("f.entities").cast("long").alias("n"), shown.alias("entities"), F.array_join("f.constraints", ",").alias("constraints"), F.array_join("f.concepts", ",").alias("concepts"))


@query("""WITH f AS (SELECT 'N' || c_nationkey AS entity_id, lower(c_mktsegment) AS normalized, c_name AS value, 0.5 + c_custkey % 50 / 100 AS weight FROM customer),
d AS (SELECT s_suppkey AS question_id, 'N' || s_nationkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'fuzzy_candidate' ELSE 'unknown' END AS status, 0.8 + s_suppkey % 20 / 100 AS score FROM supplier),
u AS (SELECT question_id, f.*, CASE status WHEN 'resolved' THEN round(weight, 4) ELSE round(least(0.76, score * 0.82), 4) END AS w FROM d JOIN f USING (entity_id) WHERE status = 'resolved' OR (status = 'fuzzy_candidate' AND score >= 0.88))
SELECT question_id, entity_id, normalized, value, w AS weight FROM u QUALIFY row_number() OVER (PARTITION BY question_id, entity_id, normalized ORDER BY w DESC, value DESC) = 1""")
def entity_phrases(spark, sf_dir):
    """Weighted forms of the entities of a question; fuzzy ones weigh 0.76 at most."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    name = lambda k: F.concat(F.lit("N"), F.col(k).cast("string")).alias("entity_id")
    forms = c.select(name("c_nationkey"), F.lower("c_mktsegment").alias("normalized"), F.col("c_name").alias("value"), (0.5 + F.col("c_custkey") % 50 / 100).alias("weight"))
    status = F.element_at(F.array(*map(F.lit, ("resolved", "fuzzy_candidate", "unknown"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    found = s.select(F.col("s_suppkey").alias("question_id"), name("s_nationkey"), status.alias("status"), (0.8 + F.col("s_suppkey") % 20 / 100).alias("score"))
    return planner.entity_phrases(found, forms, 0.88)


@query(f"""WITH {_BM25}, s AS (SELECT query_id, document_id, score, CAST(substr(document_id, 7) AS BIGINT) * 7 % 100 / 100 AS rerank FROM lex)
SELECT query_id, document_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, document_id) AS place FROM s WHERE rerank >= 0.3 QUALIFY place <= 8""")
def reranked_hits(spark, sf_dir):
    """A reranker's scores come as a column; hits under the least score go, the best eight stay."""
    hits = lexical_hits(spark, sf_dir).select("query_id", "document_id", "score")
    scores = hits.select("query_id", "document_id", (F.substring("document_id", 7, 20).cast("long") * 7 % 100 / 100).alias("rerank"))
    return planner.reranked(hits, scores, 0.3, 8).select("query_id", "document_id", "rerank", F.col("place").cast("long"))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, length(content) AS n FROM lex JOIN corpus USING (document_id)), g AS (SELECT query_id, count(*) AS results, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY 1)
SELECT query_id, results, chars, CASE WHEN results > 20 THEN 'max_results' WHEN chars > 40000 THEN 'max_evidence_chars' ELSE 'ok' END AS verdict FROM g""")
def batch_budgets(spark, sf_dir):
    """Whether a batch of results stays within what was granted."""
    texts = corpus(spark, sf_dir).select("document_id", F.col("content").alias("text"))
    return planner.within_budget(lexical_hits(spark, sf_dir).join(texts, "document_id"), 20, 40_000)


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS v FROM benchmark), q AS (SELECT item_id, v[1] AS a, v[2] AS b, v[3] AS c FROM w WHERE len(list_distinct(v[1:3])) = 3)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN a || ' ' || b || ' ' || c ELSE c || CASE WHEN item_id % 3 = 1 THEN ' ' || b ELSE '' END || ' +"' || a || ' ' || b || '"' END AS query FROM q""")
def quoted_phrases(spark, sf_dir):
    """Phrases that a user quotes survive the rewriting of the query."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    q = table(spark, sf_dir, "benchmark").select("item_id", w.alias("v")).where(F.size(F.array_distinct(F.slice("v", 1, 3))) == 3)
    q = q.select("item_id", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate("abc")))
    phrase = F.concat(F.lit('+"'), F.col("a"), F.lit(" "), F.col("b"), F.lit('"'))
    kind = F.col("item_id") % 3
    original = F.when(kind == 0, F.concat_ws(" ", "a", "b")).when(kind == 1, F.concat_ws(" ", phrase, F.col("b"))).otherwise(phrase)
    rewritten = F.when(kind == 0, F.concat_ws(" ", "a", "b", "c")).otherwise(F.concat_ws(" ", F.col("a"), F.col("c"), F.col("b"), F.concat(F.lit('"'), F.upper("a"), F.lit(" "), F.col("b"), F.lit('"'))))
    return q.select("item_id", planner.kept_phrases(original, rewritten).alias("query"))


@query("""SELECT c_custkey, c_name AS name FROM customer""")
def person_names(spark, sf_dir):
    """Titles before names go, however many stand there."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    titled = F.when(n == 0, F.concat(F.lit("Herr Dr. "), F.col("c_name"))).when(n == 1, F.concat(F.lit(" Frau Prof. Dr. , "), F.col("c_name"), F.lit(" ;"))).when(n == 2, F.concat(F.lit("Dipl.-Ing. "), F.col("c_name"))).when(n == 3, F.concat(F.lit("Rechtsanwältin "), F.col("c_name"))).otherwise(F.col("c_name"))
    plain = F.when(n == 3, F.concat(F.lit("Rechtsanwaltin "), F.col("c_name"))).otherwise(titled)
    return c.select("c_custkey", planner.person_name(plain).alias("name"))


@query("""WITH b AS (SELECT DISTINCT p_brand || '/' || split_part(p_type, ' ', 1) || '/' || p_size AS name, p_size % 4 <> 0 AS selectable FROM part),
r(root) AS (SELECT DISTINCT p_brand || '/' || split_part(p_type, ' ', 1) FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'Hidden/' || n_name FROM nation WHERE n_nationkey < 3)
SELECT DISTINCT name FROM b WHERE selectable AND EXISTS (SELECT 1 FROM r WHERE name = root OR starts_with(name, root || '/')) UNION SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE name = root OR starts_with(name, root || '/'))""")
def mailbox_tree(spark, sf_dir):
    """Part types as mailboxes below brands; roots that the listing doesn't show stay."""
    p, first = table(spark, sf_dir, "part"), F.substring_index("p_type", " ", 1)
    listed = p.select(F.concat_ws("/", "p_brand", first, F.col("p_size").cast("string")).alias("name"), (F.col("p_size") % 4 != 0).alias("selectable")).distinct()
    hidden = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("Hidden/"), F.col("n_name")).alias("root"))
    return planner.mailboxes(listed, p.where("p_partkey % 7 = 0").select(F.concat_ws("/", "p_brand", first).alias("root")).unionByName(hidden))


_RECALL = r"""ask AS (SELECT item_id AS query_id, regexp_extract(lower(text), '[a-z]{4,} [a-z]{4,}') AS phrase, regexp_extract_all(lower(text), '[a-z]{9,}')[1:3] AS terms FROM benchmark)"""


@query(rf"""WITH {CORPUS}, {_RECALL}, tok AS (SELECT document_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM corpus),
j AS (SELECT document_id, ' ' || array_to_string(w, ' ') || ' ' AS joined, w FROM tok)
SELECT query_id, count(*) AS n, min(document_id) AS first FROM ask, j WHERE (phrase <> '' AND contains(joined, ' ' || phrase || ' ')) OR list_has_any(w, terms) GROUP BY 1""")
def recall_backoff(spark, sf_dir):
    """One of the entity's phrases or terms is mandatory. Terms and first words of phrases meet documents by equal words."""
    b = table(spark, sf_dir, "benchmark")
    ask = b.select(F.col("item_id").alias("query_id"), F.regexp_extract(F.lower("text"), "[a-z]{4,} [a-z]{4,}", 0).alias("phrase"), F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)), 1, 3).alias("terms"))
    words = ask.select("query_id", F.explode("terms").alias("word"), F.lit(None).cast("string").alias("after"))
    pairs = ask.where("phrase <> ''").select("query_id", F.substring_index("phrase", " ", 1).alias("word"), F.substring_index("phrase", " ", -1).alias("after"))
    w = lexical.words(F.col("content"))
    tokens = lexical.spread(corpus(spark, sf_dir).select("document_id", "content")).select("document_id", w.alias("w")).select("document_id", F.posexplode("w").alias("pos", "word"), F.col("w")).select("document_id", "word", F.try_element_at("w", F.col("pos") + 2).alias("next")).distinct()
    wanted = words.unionByName(pairs)
    hit = tokens.join(lexical.if_small(wanted), "word").where("after is null or after = next").select("query_id", "document_id").distinct()
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first"))


@query(r"""WITH c AS (SELECT conv_id, string_agg(coalesce(text, '') || ' [[E' || turn % 3 || ']] ', '' ORDER BY turn, role, text) AS whole FROM conversations GROUP BY 1)
SELECT conv_id, md5(replace(replace(whole, '[[E0]]', '[1]'), '[[E1]]', '[2]')) AS text FROM c""")
def citation_rewriting(spark, sf_dir):
    """Markers of evidence become result numbers wherever a stream of chunks cuts them."""
    c = table(spark, sf_dir, "conversations")
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[E"), (F.col("turn") % 3).cast("string"), F.lit("]] "))
    half = F.floor(F.length("whole") - 3).cast("int")
    rows = c.select("conv_id", "turn", "role", "text", marked.alias("whole"))
    parts = rows.select("conv_id", "turn", "role", "text", F.posexplode(F.array(F.substr("whole", F.lit(1), half), F.substr("whole", half + 1, F.lit(10)))).alias("part", "chunk"))
    whole = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part", "chunk"))), lambda x: x["chunk"]), "").alias("whole"))
    return whole.select("conv_id", F.md5(F.replace(F.replace("whole", F.lit("[[E0]]"), F.lit("[1]")), F.lit("[[E1]]"), F.lit("[2]"))).alias("text"))


def _bm25_of(content: str, mark: str) -> str:
    """The parts of BM25 over a field, their names marked."""
    return rf"""tok{mark} AS (SELECT document_id, regexp_extract_all(lower({content}), '[\p{{L}}\p{{N}}]+') AS w FROM corpus),
tf{mark} AS (SELECT document_id, dl, term, count(*) AS tf FROM (SELECT document_id, len(w) AS dl, unnest(w) AS term FROM tok{mark}) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df{mark} AS (SELECT term, count(*) AS df FROM tf{mark} GROUP BY term), st{mark} AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok{mark}),
hit{mark} AS (SELECT query_id, document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf{mark} JOIN df{mark} USING (term) JOIN q USING (term), st{mark} GROUP BY query_id, document_id)"""


@query(rf"""WITH {CORPUS}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')[1:4]) AS term FROM benchmark), {_bm25_of("path || ' ' || content", "_b")}, {_bm25_of("content", "_c")},
u AS (SELECT query_id, document_id, 2 * score AS score FROM hit_b UNION ALL SELECT query_id, document_id, score FROM hit_c), m AS (SELECT query_id, document_id, max(score) * CAST(1.5 AS DOUBLE) AS score FROM u GROUP BY ALL)
SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM m QUALIFY rank <= 10""")
def field_search(spark, sf_dir):
    """L1, L2: the best of name and text together and of the text, boosted; the first words of each benchmark text ask."""
    b = table(spark, sf_dir, "benchmark")
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.slice(lexical.words(F.col("text")), 1, 4))).alias("term"))
    return lexical.top_k(lexical.best_field(corpus(spark, sf_dir), terms, 1.5), 10, "query_id").select("query_id", "document_id", "score", F.col("rank").cast("long"))


@query(rf"""WITH {CORPUS}, f AS (SELECT item_id AS query_id, regexp_extract(lower(text), '([a-z]{{2,}}) ([a-z]{{2,}})', 1) AS a, regexp_extract(lower(text), '([a-z]{{2,}}) ([a-z]{{2,}})', 2) AS b FROM benchmark), g AS (SELECT query_id, a, b, CASE WHEN query_id % 2 = 0 THEN 2.4 ELSE 1.0 END AS boost FROM f WHERE a <> ''),
j AS (SELECT document_id, ' ' || array_to_string(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM corpus)
SELECT query_id, count(*) AS n, max(CAST(boost AS DOUBLE)) AS score, min(document_id) AS first FROM g, j WHERE contains(t, ' ' || a || ' ' || b || ' ') OR (query_id % 2 = 0 AND regexp_matches(t, ' ' || a || ' [^ ]+ ' || b || ' ')) GROUP BY 1""")
def entity_forms(spark, sf_dir):
    """Forms of entities as phrases; those of persons (every second question) may have a word between and weigh 2.4."""
    pair = lambda i: F.regexp_extract(F.lower("text"), "([a-z]{2,}) ([a-z]{2,})", i)
    person = F.col("item_id") % 2 == 0
    forms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), pair(1).alias("first"), pair(2).alias("second"), F.when(person, 1).otherwise(0).alias("slop"), F.when(person, 2.4).otherwise(1.0).alias("boost")).where("first <> ''")
    hit = lexical.entity_groups(corpus(spark, sf_dir), forms)
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.min("document_id").alias("first"))


@query(r"""WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')[1:6]) AS term FROM benchmark)), v AS (SELECT DISTINCT expansion FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS expansion FROM documents)),
n AS (SELECT term, expansion, levenshtein(term, expansion) AS distance, CASE WHEN length(term) < 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM t JOIN v ON substr(term, 1, 2) = substr(expansion, 1, 2) AND abs(length(term) - length(expansion)) <= 2 AND term <> expansion AND regexp_matches(expansion, '^[a-z]+$'))
SELECT term, expansion, distance, CAST(0.35 AS DOUBLE) AS boost FROM n WHERE distance <= edits QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, expansion) <= 50""")
def fuzzy_siblings(spark, sf_dir):
    """Near words of the corpus for the words of a question."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 6)).alias("term"))
    vocabulary = lexical.spread(corpus(spark, sf_dir).select("content")).select(F.explode(lexical.words(F.col("content"))).alias("term")).where("term rlike '^[a-z]+$'").distinct()
    return lexical.fuzzy_terms(terms, vocabulary).withColumn("distance", F.col("distance").cast("long"))
