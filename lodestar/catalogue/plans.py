"""Questions, specifications, entity detection and admission."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalogue.registry import area
from lodestar.operators import admission, spans
from lodestar.operators.lexical import spread, words
from lodestar.plans import intents, specs
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()

# Questions made of the words of each benchmark text: the driver's tables hold none.
_ASK = """CASE item_id % 10 WHEN 0 THEN 'Zeige alle ' || w || ' Rechnungen' WHEN 1 THEN 'Rechnungen von ' || w || ' aus ' || (1990 + item_id % 40) WHEN 2 THEN '+' || w || ' +"' || w || ' plan" rest'
  WHEN 3 THEN 'öffne bitte "' || w || '.pdf"' WHEN 4 THEN 'Wie viele ' || w || ' Belege gibt es' WHEN 5 THEN 'Dokumente AB-' || (100 + item_id) || ' zu ' || w WHEN 6 THEN 'Wie viele ' || repeat(w || ' ', 20) || 'Belege'
  WHEN 7 THEN 'vollständige Liste zu ' || w WHEN 8 THEN '+' || w || ' ' || w || '.txt, lesen' ELSE w END"""


def questions(spark, sf_dir):
    """A question for each benchmark text, after its first word of four letters or more."""
    w, i, lit = F.col("w"), F.col("item_id"), F.lit
    kinds = [
        F.concat(lit("Zeige alle "), w, lit(" Rechnungen")), F.concat(lit("Rechnungen von "), w, lit(" aus "), (1990 + i % 40).cast("string")), F.concat(lit("+"), w, lit(' +"'), w, lit(' plan" rest')),
        F.concat(lit('öffne bitte "'), w, lit('.pdf"')), F.concat(lit("Wie viele "), w, lit(" Belege gibt es")), F.concat(lit("Dokumente AB-"), (100 + i).cast("string"), lit(" zu "), w),
        F.concat(lit("Wie viele "), F.repeat(F.concat(w, lit(" ")), lit(20)), lit("Belege")), F.concat(lit("vollständige Liste zu "), w), F.concat(lit("+"), w, lit(" "), w, lit(".txt, lesen")), w,
    ]
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "[a-z]{4,}", 0).alias("w")).where("w <> ''")
    return b.select("item_id", "w", F.element_at(F.array(*kinds), (i % 10).cast("int") + 1).alias("text"))


@query(rf"""WITH b AS (SELECT item_id, regexp_extract(text, '[a-z]{{4,}}') AS w FROM benchmark), q AS (SELECT item_id, w, {_ASK} AS text FROM b WHERE w <> ''),
t AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*') AS v FROM q),
f AS (SELECT *, regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}-])alle .*(^|[^\p{{L}}\p{{N}}-])(rechnungen|belege|dokumente)($|[^\p{{L}}\p{{N}}-])') OR regexp_matches(lower(text), 'wie viele( .{{0,78}})? belege') OR contains(lower(text), 'vollständige liste') AS exhaustive FROM t)
SELECT item_id, exhaustive, NOT exhaustive AND list_has_any(v, ['rechnungen', 'belege', 'dokumente', 'invoice', 'invoices', 'document', 'documents', 'file', 'files', 'mail', 'mails', 'brief', 'briefe', 'minute', 'minutes', 'offer', 'offers', 'statement', 'statements', 'receipt', 'receipts']) AND regexp_matches(text, '(^|[^0-9])(19|20)[0-9][0-9]($|[^0-9])|[A-Z][A-Z]-[0-9][0-9]') AS bounded,
  item_id % 10 = 2 AS strict, CASE item_id % 10 WHEN 3 THEN w || '.pdf' WHEN 8 THEN w || '.txt' ELSE '' END AS file_name, item_id % 10 = 3 AS navigation FROM f""")
def question_intents(spark, sf_dir):
    """F23, F24, F25, F27, F28, F29."""
    t = F.col("text")
    return questions(spark, sf_dir).select("item_id", intents.exhaustive(t).alias("exhaustive"), intents.bounded(t).alias("bounded"), intents.strict(t).alias("strict"), intents.file_name(t).alias("file_name"), intents.navigation(t).alias("navigation"))


@query(r"""WITH w AS (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS v FROM benchmark)
SELECT item_id, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)[1:12], '|') AS terms FROM w""")
def spec_terms(spark, sf_dir):
    """The words of each benchmark text as a cleaned list."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(specs.clean_list(F.split("text", " "), 12), "|").alias("terms"))


@query(r"""SELECT item_id, sha256('[["' || array_to_string(list_sort(list_transform(regexp_extract_all(text, '[a-z]{5,}'), lambda x: lower(x))), '","') || '"]]') AS fingerprint FROM benchmark WHERE len(regexp_extract_all(text, '[a-z]{5,}')) > 0""")
def spec_fingerprint(spark, sf_dir):
    """X30, X11, X13."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    return b.select("item_id", specs.fingerprint(F.col("w")).alias("fingerprint"))


@query("""WITH c AS (SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS authorized FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN authorized > 50 THEN 'authorized_overflow' WHEN total > 51 AND 51 >= 51 THEN 'scan_limit_reached' END AS overflow FROM c""")
def strict_overflow(spark, sf_dir):
    """F30."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("authorized"))
    return c.select("c_nationkey", specs.overflow(F.col("total"), F.lit(51), F.col("authorized"), 50, 40).alias("overflow"))


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text || ' see [' || turn || '] and [99] or [2]', '\[([0-9]{1,4})\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 10))), ',') AS cited FROM conversations""")
def cited_results(spark, sf_dir):
    """X45."""
    c = table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.lit(" see ["), F.col("turn").cast("string"), F.lit("] and [99] or [2]"))
    return c.select("conv_id", "turn", F.array_join(specs.cited(answer, F.lit(10)).cast("array<string>"), ",").alias("cited"))


@query("""SELECT s_suppkey, '+' || s_suppkey || ' +"' || s_name || ' x"' AS probe FROM supplier""")
def file_probes(spark, sf_dir):
    """X25."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", specs.file_probe(F.array(F.col("s_suppkey").cast("string"), F.concat("s_name", F.lit(" x")))).alias("probe"))


_FORMS = r"forms AS (SELECT DISTINCT lower(regexp_extract(text, '([a-zA-Z]{6,}) ', 1)) AS normalized, 'E' || min(item_id) OVER (PARTITION BY lower(regexp_extract(text, '([a-zA-Z]{6,}) ', 1))) AS entity_id FROM benchmark WHERE regexp_matches(text, '[a-zA-Z]{6,} '))"


def forms(spark, sf_dir):
    """Names to look for: the first longer word of each benchmark text."""
    word = F.lower(F.regexp_extract("text", "([a-zA-Z]{6,}) ", 1))
    return table(spark, sf_dir, "benchmark").where(F.col("text").rlike("[a-zA-Z]{6,} ")).groupBy(word.alias("normalized")).agg(F.concat(F.lit("E"), F.min("item_id").cast("string")).alias("entity_id"))


@query(rf"""WITH {CORPUS}, {_FORMS}, t AS (SELECT doc_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM corpus), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM t)
SELECT doc_id AS text_id, entity_id, count(*) AS n, min(pos) AS first FROM p JOIN forms ON word = normalized GROUP BY ALL""")
def exact_mentions(spark, sf_dir):
    """Names in documents by word runs."""
    found = spans.exact_matches(corpus(spark, sf_dir).select(F.col("doc_id").alias("text_id"), F.col("content").alias("text")), forms(spark, sf_dir), most=1)
    return found.groupBy("text_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first"))


@query()
def longest_mentions(spark, sf_dir):
    """Of overlapping names of one or two words the longest, in the benchmark texts."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    two = b.select(F.lower(F.regexp_extract("text", "([a-zA-Z]+ [a-zA-Z]+) ", 1)).alias("normalized"), F.concat(F.lit("T"), F.col("text_id").cast("string")).alias("entity_id"))
    return spans.longest_first(spans.exact_matches(b, forms(spark, sf_dir).unionByName(two), most=2))


@query()
def fuzzy_mentions(spark, sf_dir):
    """Names of two words that spans of two or three words of the documents nearly match."""
    pair = F.lower(F.regexp_extract("text", "([a-zA-Z]+ [a-zA-Z]+) ", 1))
    names = table(spark, sf_dir, "benchmark").select(pair.alias("normalized"), F.col("item_id")).where("normalized <> ''").groupBy("normalized").agg(F.concat(F.lit("T"), F.min("item_id").cast("string")).alias("entity_id"))
    w = words(F.col("content"))
    later = lambda k: F.slice(w, k + 1, F.size(w)).alias(f"w{k}")
    zipped = spread(corpus(spark, sf_dir).where("content is not null").select("doc_id", "content")).select(F.col("doc_id").alias("text_id"), F.posexplode(F.arrays_zip(later(0), later(1), later(2))).alias("pos", "z")).select("text_id", "pos", "z.*")
    runs = zipped.withColumn("size", F.explode(F.array(F.lit(2), F.lit(3)))).where("case size when 2 then w1 else w2 end is not null").select("text_id", "pos", "size", F.when(F.col("size") == 2, F.concat_ws(" ", "w0", "w1")).otherwise(F.concat_ws(" ", "w0", "w1", "w2")).alias("gram"))
    return spans.fuzzy_matches(runs, names, 85.0).select("text_id", "gram", "entity_id", "ratio").distinct()


@query("""WITH s AS (SELECT doc_id, doc_id * 37 % 400 AS a, doc_id * 53 % 400 AS b, doc_id * 71 % 400 AS c, doc_id * 89 % 400 AS d FROM documents), k2 AS (SELECT *, abs(a - b) > 45 AS kb FROM s),
k3 AS (SELECT *, abs(a - c) > 45 AND NOT (kb AND abs(b - c) <= 45) AS kc FROM k2)
SELECT doc_id, 1 + CAST(kb AS BIGINT) + CAST(kc AS BIGINT) + CAST(abs(a - d) > 45 AND NOT (kb AND abs(b - d) <= 45) AND NOT (kc AND abs(c - d) <= 45) AS BIGINT) AS kept FROM k3""")
def window_overlap(spark, sf_dir):
    """Four windows of 100 characters at places that differ by document; those that a kept one covers by 55 % or more go."""
    at = lambda n: (F.col("doc_id") * n % 400).cast("int")
    windows = F.array(*(F.struct(at(n).alias("start"), (at(n) + 100).alias("end")) for n in (37, 53, 71, 89)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(spans.kept_windows(windows)).cast("long").alias("kept"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'https://x.org' WHEN 1 THEN 'a@b.org' WHEN 2 THEN '12-34' WHEN 3 THEN 'plan.pdf' WHEN 4 THEN 'Customer' ELSE c_name END AS name, CASE WHEN c_acctbal > 5000 THEN 0.7 ELSE 0.4 END AS score FROM customer)
SELECT c_custkey, name = c_n AS eligible, name = c_n AND score >= 0.6 AS may_create, CASE c_custkey % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'email' WHEN 2 THEN 'number' WHEN 3 THEN 'file' WHEN 4 THEN 'generic' ELSE 'ok' END AS reason FROM n JOIN (SELECT c_custkey, c_name AS c_n FROM customer) USING (c_custkey)""")
def entity_admission(spark, sf_dir):
    """F32, F33, F34."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey") % 6
    name = F.when(n == 0, "https://x.org").when(n == 1, "a@b.org").when(n == 2, "12-34").when(n == 3, "plan.pdf").when(n == 4, "Customer").otherwise(F.col("c_name"))
    score = F.when(F.col("c_acctbal") > 5000, 0.7).otherwise(0.4)
    return c.select("c_custkey", admission.admitted(name, F.lit("PERSON"), score).alias("a")).select("c_custkey", "a.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_predicate' WHEN o_orderkey % 5 = 1 THEN 'domain' WHEN o_orderkey % 5 = 2 THEN 'range' WHEN NOT contains(lower(o_orderpriority), 'ur') THEN 'no_cue' ELSE 'ok' END AS reason FROM orders""")
def relation_checks(spark, sf_dir):
    """Predicate, domain, range and cue."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    r = o.select("o_orderkey", F.when(n == 0, "KNOWS").otherwise("PLACED").alias("predicate"), F.when(n == 1, "PLACE").otherwise("PERSON").alias("subject_type"), F.when(n == 2, "PLACE").otherwise("ORDER").alias("object_type"), F.when(F.contains(F.lower("o_orderpriority"), F.lit("ur")), "an order").otherwise("nothing").alias("evidence"))
    return admission.checked_relations(r, admission.ontology(spark)).select("o_orderkey", "reason")


@query("""WITH r AS (SELECT p_brand AS predicate, list(DISTINCT split_part(p_type, ' ', 1)) FILTER (WHERE p_size % 3 = 0) AS domains, list(DISTINCT split_part(p_type, ' ', 2)) FILTER (WHERE p_size % 3 = 1) AS ranges FROM part WHERE p_size < 12 GROUP BY 1),
t AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS subject_type, split_part(p_type, ' ', 2) AS object_type FROM part WHERE p_size > 30)
SELECT subject_type, object_type, predicate FROM t JOIN r ON list_contains(domains, subject_type) AND list_contains(ranges, object_type)""")
def compatible_predicates(spark, sf_dir):
    """brands as predicates, with the first and second words of their part types as domains and ranges."""
    p, word = table(spark, sf_dir, "part"), lambda i: F.split_part("p_type", F.lit(" "), F.lit(i))
    rules = p.where("p_size < 12").groupBy(F.col("p_brand").alias("predicate")).agg(F.collect_set(F.when(F.col("p_size") % 3 == 0, word(1))).alias("domains"), F.collect_set(F.when(F.col("p_size") % 3 == 1, word(2))).alias("ranges"))
    types = p.where("p_size > 30").select(word(1).alias("subject_type"), word(2).alias("object_type")).distinct()
    return admission.compatible(rules, types)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN contains(lower(substr(text, 5, 40)), 'th') ELSE FALSE END AS grounded FROM documents""")
def grounding(spark, sf_dir):
    """the evidence is in the text and a form in the evidence."""
    evidence = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 40)).otherwise("not in any text at all")
    return table(spark, sf_dir, "documents").select("doc_id", admission.grounded(evidence, F.col("text"), F.array(F.lit("TH"))).alias("grounded"))


@query("""WITH a AS (SELECT doc_id, 'prior' AS via, n_chars FROM documents WHERE n_chars > 8000 UNION ALL SELECT doc_id, 'new', n_chars FROM documents WHERE n_chars > 4000)
SELECT doc_id, via FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY via DESC) = 1""")
def followup_evidence(spark, sf_dir):
    """Prior evidence first, then what is new."""
    d = table(spark, sf_dir, "documents")
    both = d.where("n_chars > 8000").select("doc_id", F.lit("prior").alias("via"), F.lit(0).alias("o")).unionByName(d.where("n_chars > 4000").select("doc_id", F.lit("new").alias("via"), F.lit(1).alias("o")))
    first = Window.partitionBy("doc_id").orderBy("o")
    return both.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "via")


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red widget' OR starts_with(lower(p_name), 'red') ORDER BY CASE WHEN lower(p_name) = 'red widget' THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 10""")
def find_entities(spark, sf_dir):
    """An exact name first, then names with the prefix."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    low, asked = F.lower("p_name"), "red widget"
    return p.where((low == asked) | low.startswith("red")).orderBy(F.when(low == asked, 0).otherwise(1), "p_name", "p_partkey").limit(10)
