"""Registers, logs, runs and repairs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalogue.operations import _JOBS, jobs
from lodestar.catalogue.registry import area
from lodestar.functions import text
from lodestar.operators import queue, registers, sync
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()


@query("""SELECT user_id AS probe, bool_or(value > 90) AS degraded, bool_or(event_type = 'error') AS failed, count(*) AS backends, bool_or(value > 90) OR bool_or(event_type = 'error') AS any_problem FROM events GROUP BY 1""")
def backend_status(spark, sf_dir):
    """The states of several backends folded into one: a problem of any is a problem."""
    bad, failed = F.col("value") > 90, F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("probe")).agg(F.bool_or(bad).alias("degraded"), F.bool_or(failed).alias("failed"), F.count(F.lit(1)).alias("backends"), F.bool_or(bad | failed).alias("any_problem"))


@query("""SELECT c_mktsegment AS source, c_nationkey AS run_id, count(*) AS contacts, count(*) FILTER (WHERE c_acctbal < 0) AS rejected, max(c_custkey) AS newest FROM customer GROUP BY ALL""")
def import_runs(spark, sf_dir):
    """Sources of contacts and what each import run brought."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("run_id")).agg(F.count(F.lit(1)).alias("contacts"), F.count_if(F.col("c_acctbal") < 0).alias("rejected"), F.max("c_custkey").alias("newest"))


@query("""SELECT event_id AS entry_id, event_type AS kind FROM events""")
def research_log(spark, sf_dir):
    """Entries are inserted once, however often they come; the stored table is written, read and extended."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("event_type").alias("kind"))
    again = e.where("entry_id % 3 <> 0")
    return registers.logged(e.where("entry_id % 2 = 0"), e.unionByName(again), "entry_id")


@query("""WITH p AS (SELECT item_id AS id, ' ' || lower(text) AS query, ['vector', 'files'] AS arms FROM benchmark UNION ALL SELECT item_id + 100000, text || ' ', ['files', 'vector'] FROM benchmark UNION ALL SELECT item_id + 200000, text, ['files'] FROM benchmark WHERE item_id % 2 = 0)
SELECT min(id) AS id, count(*) AS n FROM p GROUP BY lower(trim(query)), list_sort(arms)""")
def probe_dedupe(spark, sf_dir):
    """Probes of one query and one set of arms are one."""
    b, both = table(spark, sf_dir, "benchmark"), F.array(F.lit("vector"), F.lit("files"))
    p = b.select(F.col("item_id").alias("id"), F.concat(F.lit(" "), F.lower("text")).alias("query"), both.alias("arms"))
    p = p.unionByName(b.select((F.col("item_id") + 100000).alias("id"), F.concat("text", F.lit(" ")).alias("query"), F.reverse(both).alias("arms")))
    p = p.unionByName(b.where("item_id % 2 = 0").select((F.col("item_id") + 200000).alias("id"), F.col("text").alias("query"), F.array(F.lit("files")).alias("arms")))
    return p.groupBy(F.lower(F.trim("query")).alias("q"), F.array_sort("arms").alias("a")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n")


@query("""WITH f AS (SELECT 'P' || p_partkey AS entity_id, lower(p_name) AS normalized, p_partkey % 2 = 0 AS named FROM part UNION SELECT 'P' || p_partkey, lower(p_name || ' ' || p_brand), FALSE FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT DISTINCT lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' extra' ELSE substr(p_name, 1, 5) END) AS mention FROM part WHERE p_partkey % 10 = 0), c AS (SELECT 'P' || p_partkey AS entity_id, p_size % 5 AS shared FROM part WHERE p_size > 10),
x AS (SELECT mention, entity_id, max(CASE WHEN normalized = mention THEN CASE WHEN named THEN 0.98 ELSE 0.93 END ELSE CASE WHEN named THEN 0.82 ELSE 0.78 END END) AS score FROM m JOIN f ON starts_with(normalized, mention) OR starts_with(mention, normalized) WHERE length(mention) >= 3 AND length(normalized) >= 3 GROUP BY ALL),
s AS (SELECT mention, x.entity_id, CAST(round(score + least(coalesce(shared, 0) * 0.03, 0.09), 4) AS DOUBLE) AS score FROM x LEFT JOIN c ON x.entity_id = c.entity_id)
SELECT mention, entity_id, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id) AS place FROM s QUALIFY place <= 5""")
def match_scores(spark, sf_dir):
    """Entities of mentions by equal names and by prefixes in either direction, scored with shared contexts."""
    p, entity = table(spark, sf_dir, "part"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id")
    forms = p.select(entity, F.lower("p_name").alias("normalized"), (F.col("p_partkey") % 2 == 0).alias("named")).unionByName(p.where("p_partkey % 3 = 0").select(entity, F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("normalized"), F.lit(False).alias("named")))
    k = F.col("p_partkey") % 3
    mention = F.lower(F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" extra"))).otherwise(F.substring("p_name", 1, 5)))
    found = registers.prefix_matches(p.where("p_partkey % 10 = 0").select(mention.alias("mention")), forms)
    scored = registers.match_scores(found, p.where("p_size > 10").select(entity, (F.col("p_size") % 5).alias("shared")))
    return registers.best_candidates(scored, 5).withColumn("place", F.col("place").cast("long"))


@query("""SELECT l_orderkey AS document_id, l_linenumber AS chunk_no, CASE WHEN l_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM lineitem""")
def chunk_upsert(spark, sf_dir):
    """K1, K5: chunk points by an id that follows from document and number; writing them twice changes nothing."""
    point = text.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_no").cast("string")))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_no")).withColumn("point_id", point)
    new = c.where("document_id % 4 = 0").withColumn("state", F.lit("new"))
    once = sync.upsert(c.withColumn("state", F.lit("old")), new, "point_id")
    return sync.upsert(once, new, "point_id").select("document_id", "chunk_no", "state")


@query(f"""WITH {_JOBS}, s AS (SELECT document_id, arg_max(status, job_id) AS last, max(attempts) AS attempts, count(*) AS events FROM j GROUP BY 1)
SELECT document_id, CASE last WHEN 'done' THEN 'completed' WHEN 'running' THEN 'claimed' WHEN 'failed' THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'retry' END ELSE 'pending' END AS state, events FROM s""")
def outbox_states(spark, sf_dir):
    """What enqueueing, claiming, completing and failing left of each entry of the outbox."""
    s = jobs(spark, sf_dir).groupBy("document_id").agg(F.max_by("status", "job_id").alias("last"), F.max("attempts").alias("attempts"), F.count(F.lit(1)).alias("events"))
    last = F.col("last")
    state = F.when(last == "done", "completed").when(last == "running", "claimed").when(last == "failed", F.when(F.col("attempts") >= 5, "dead").otherwise("retry")).otherwise("pending")
    return s.select("document_id", state.alias("state"), "events")


@query("""SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new@x.org' ELSE c_mktsegment || '@x.org' END AS email FROM customer""")
def contact_upserts(spark, sf_dir):
    """M2: contacts by their id; what an update leaves blank stays."""
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("contact_id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("@x.org")).alias("email"))
    update = c.select(F.col("c_custkey").alias("contact_id"), F.when(F.col("c_custkey") % 4 == 0, F.lower("c_name")).otherwise(" ").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "new@x.org").alias("email"))
    return sync.upsert_filled(base, update, "contact_id")


@query("""WITH h AS (SELECT o_custkey AS contact_id, arg_max('E' || o_orderkey % 50, o_orderkey) AS entity_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS contact_id, CASE WHEN c_nationkey = 7 THEN h.entity_id ELSE 'N' || c_nationkey END AS entity_id FROM customer LEFT JOIN h ON h.contact_id = c_custkey WHERE c_nationkey <> 7 OR h.entity_id IS NOT NULL""")
def reassigned_contacts(spark, sf_dir):
    """M6: rolling back an import gives contacts the entity they had before."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.col("c_nationkey").cast("long").alias("run_id"))
    h = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("contact_id"), F.concat(F.lit("E"), (F.col("o_orderkey") % 50).cast("string")).alias("entity_id"), F.col("o_orderkey").alias("run_id"))
    return registers.reassigned(c, h, F.col("run_id") == 7).select("contact_id", "entity_id")


@query(f"""WITH {CORPUS}, d AS (SELECT document_id, doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'internal' END AS stated, CASE WHEN starts_with(path, 'Archive/Mail/') THEN 'mail' WHEN starts_with(path, 'Archive/Chats/') THEN 'chat' WHEN starts_with(path, 'Archive/Web/') THEN 'web' ELSE 'internal' END AS derived FROM corpus)
SELECT document_id, CASE WHEN doc_id % 23 = 0 THEN 'web' ELSE derived END AS origin, stated AS was FROM d WHERE (CASE WHEN doc_id % 23 = 0 THEN 'web' ELSE derived END) IS DISTINCT FROM stated""")
def repaired_origins(spark, sf_dir):
    """Documents whose stated origin the registry, or else their path, contradicts, with the update."""
    d = corpus(spark, sf_dir)
    under = lambda root: F.col("path").startswith(f"Archive/{root}/")
    derived = F.when(under("Mail"), "mail").when(under("Chats"), "chat").when(under("Web"), "web").otherwise("internal")
    docs = d.select("document_id", F.when(F.col("doc_id") % 9 != 0, "internal").alias("stated"), derived.alias("derived"))
    return registers.repaired_origins(docs, d.where("doc_id % 23 = 0").select("document_id", F.lit("web").alias("origin")))


@query("""WITH a AS (SELECT event_id, event_id * 7919 % 256 AS a, event_id * 104729 % 256 AS b, event_id * 31 % 256 AS c, event_id % 300 AS d FROM events), v AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 192 WHEN 2 THEN 172 ELSE a END AS a2 FROM a)
SELECT event_id, d <= 255 AND NOT (a2 IN (0, 10, 127) OR a2 >= 224 OR (a2 = 100 AND b BETWEEN 64 AND 127) OR (a2 = 169 AND b = 254) OR (a2 = 172 AND b BETWEEN 16 AND 31) OR (a2 = 192 AND b = 168) OR (a2 = 192 AND b = 0 AND c IN (0, 2)) OR (a2 = 198 AND b BETWEEN 18 AND 19) OR (a2 = 198 AND b = 51 AND c = 100) OR (a2 = 203 AND b = 0 AND c = 113)) AS public FROM v""")
def public_addresses(spark, sf_dir):
    """which addresses may be fetched from."""
    i = F.col("event_id")
    first = F.when(i % 5 == 0, 10).when(i % 5 == 1, 192).when(i % 5 == 2, 172).otherwise(i * 7919 % 256)
    address = F.concat_ws(".", *(c.cast("string") for c in (first, i * 104729 % 256, i * 31 % 256, i % 300)))
    return table(spark, sf_dir, "events").select("event_id", registers.public_address(address).alias("public"))


@query(f"""WITH {CORPUS}, p AS (SELECT document_id, 3 AS priority FROM corpus WHERE (starts_with(lower(path), 'docs/src1/') OR starts_with(lower(path), 'docs/src3/')) UNION ALL SELECT document_id, 1 FROM corpus WHERE doc_id % 5 = 0)
SELECT document_id, min(priority) AS priority, count(*) AS requests FROM p GROUP BY 1""")
def scoped_enqueue(spark, sf_dir):
    """Documents of a path scope join the queue; requests of one document are one, at the best priority."""
    d = corpus(spark, sf_dir)
    scoped = d.where(F.lower("path").startswith("docs/src1/") | F.lower("path").startswith("docs/src3/")).select("document_id", F.lit(3).alias("priority"))
    asked = scoped.unionByName(d.where("doc_id % 5 = 0").select("document_id", F.lit(1).alias("priority"))).withColumn("job_id", F.lit(0))
    return queue.coalesce_jobs(asked).select("document_id", "priority", "requests")


@query("""WITH o AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'PLANET' ELSE 'PERSON' END AS kind, CASE d.doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'no such form' ELSE upper(substr(text, 5, 6)) END AS form, CASE d.doc_id % 3 WHEN 0 THEN 'not in the text at all' ELSE substr(text, 3, 40) END AS evidence, text FROM documents d WHERE length(text) > 60 AND regexp_matches(substr(text, 1, 60), '^[a-zA-Z ,.]+$')),
f AS (SELECT *, regexp_replace(lower(evidence), '\\s+', ' ', 'g') AS e, regexp_replace(lower(form), '\\s+', ' ', 'g') AS g, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM o)
SELECT doc_id, CASE WHEN kind = 'PLANET' THEN 'kind' WHEN trim(form) = '' THEN 'empty' WHEN NOT contains(t, e) THEN 'evidence' WHEN NOT contains(e, g) THEN 'form' ELSE 'ok' END AS reason FROM f""".replace("\\\\", "\\"))
def entity_observations(spark, sf_dir):
    """Entities that a model observed in a text, and why they don't count."""
    d, i = table(spark, sf_dir, "documents").where((F.length("text") > 60) & F.substring("text", 1, 60).rlike(r"^[a-zA-Z ,.]+\z")), F.col("doc_id")
    form = F.when(i % 5 == 0, " ").when(i % 5 == 1, "no such form").otherwise(F.upper(F.substring("text", 5, 6)))
    evidence = F.when(i % 3 == 0, "not in the text at all").otherwise(F.substring("text", 3, 40))
    kind = F.when(i % 4 == 0, "PLANET").otherwise("PERSON")
    return d.select("doc_id", registers.observation_reason(kind, form, evidence, F.col("text"), ("PERSON", "ORGANIZATION", "PLACE")).alias("reason"))


@query(f"""WITH {CORPUS} SELECT document_id, length(content) AS size, doc_id % 16 AS batch FROM corpus WHERE trim(content) <> '' AND doc_id % 50 <> 3""")
def graph_inputs(spark, sf_dir):
    """The documents that the graph indexes, with text and without machine files, in batches."""
    d = corpus(spark, sf_dir).where("trim(content) <> '' and doc_id % 50 <> 3")
    return d.select("document_id", F.length("content").cast("long").alias("size"), (F.col("doc_id") % 16).alias("batch"))


@query("""WITH r AS (SELECT l_orderkey AS run_id, count(*) AS produced, count(*) FILTER (WHERE l_returnflag = 'N') AS pending FROM lineitem GROUP BY 1) SELECT o_orderkey AS run_id, o_orderstatus AS status, coalesce(produced, 0) AS produced, coalesce(pending, 0) AS pending FROM orders LEFT JOIN r ON o_orderkey = run_id""")
def run_findings(spark, sf_dir):
    """Runs with the findings they produced; runs without any stay."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("produced"), F.count_if(F.col("l_returnflag") == "N").alias("pending"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return o.join(l, "run_id", "left").select("run_id", "status", F.coalesce("produced", F.lit(0)).alias("produced"), F.coalesce("pending", F.lit(0)).alias("pending"))
