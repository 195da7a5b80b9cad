"""Synchronisation, queues, packing, conversations, curation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalogue.registry import area
from lodestar.catalogue.retrieval import _BM25, lexical_hits
from lodestar.operators import pack, queue, sync
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table
from lodestar.streaming import worker

query, QUERIES, ORACLE = area()

_DELTA = f"""{CORPUS}, inv AS (SELECT document_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN 'v1' ELSE 'v2' END AS index_signature FROM corpus WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'files:gone' || doc_id, content_hash, 'v2' FROM corpus WHERE doc_id % 17 = 0),
dl AS (SELECT coalesce(i.document_id, c.document_id) AS document_id, CASE WHEN c.document_id IS NULL THEN 'stale' WHEN i.document_id IS NULL THEN 'new' WHEN i.content_hash <> c.content_hash THEN 'changed' WHEN index_signature <> 'v2' THEN 'reindex' ELSE 'unchanged' END AS change
  FROM inv i FULL JOIN corpus c ON i.document_id = c.document_id)"""


def inventory(spark, sf_dir):
    """An older state of the index: some documents missing, some changed since, some gone from the corpus."""
    d = corpus(spark, sf_dir)
    kept = d.where("doc_id % 7 <> 0").select("document_id", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, "v1").otherwise("v2").alias("index_signature"))
    gone = d.where("doc_id % 17 = 0").select(F.concat(F.lit("files:gone"), F.col("doc_id").cast("string")).alias("document_id"), "content_hash", F.lit("v2").alias("index_signature"))
    return kept.unionByName(gone)


def changes(spark, sf_dir, complete=True):
    return sync.delta(inventory(spark, sf_dir), corpus(spark, sf_dir).select("document_id", "content_hash"), "v2", complete)


@query(f"WITH {_DELTA} SELECT document_id, change FROM dl")
def sync_delta(spark, sf_dir):
    """J7, J28, D15, X10, X11."""
    return changes(spark, sf_dir)


@query(f"WITH {_DELTA} SELECT change, count(*) AS n FROM dl GROUP BY 1")
def sync_counters(spark, sf_dir):
    """A16."""
    return changes(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DELTA} SELECT document_id, change FROM dl WHERE change <> 'stale'")
def sync_paused(spark, sf_dir):
    """R2: an incomplete scan deletes nothing."""
    return changes(spark, sf_dir, complete=False)


@query(f"WITH {_DELTA} SELECT document_id, content_hash FROM corpus UNION ALL SELECT i.document_id, i.content_hash FROM inv i WHERE i.document_id NOT IN (SELECT document_id FROM corpus)")
def inventory_upsert(spark, sf_dir):
    """K3: replaced by key."""
    return sync.upsert(inventory(spark, sf_dir).drop("index_signature"), corpus(spark, sf_dir).select("document_id", "content_hash"), "document_id")


@query(f"WITH {_DELTA} SELECT i.document_id, i.content_hash FROM inv i WHERE document_id IN (SELECT document_id FROM corpus)")
def inventory_delete(spark, sf_dir):
    """K4, M4: what the corpus no longer has goes."""
    return inventory(spark, sf_dir).join(corpus(spark, sf_dir).select("document_id"), "document_id", "left_semi").select("document_id", "content_hash")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS label FROM customer")
def registry_upsert(spark, sf_dir):
    """Blanks don't overwrite."""
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return sync.upsert_filled(base, c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "blocked").otherwise(" ").alias("label")), "id")


@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk_no FROM lineitem WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber >= 3 AND l_linenumber < 6)")
def chunk_range_delete(spark, sf_dir):
    """K2: order lines as chunks."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_no"))
    bounds = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(3).alias("first"), F.lit(6).alias("end"))
    return sync.delete_range(chunks, bounds)


_JOBS = "j AS (SELECT event_id AS job_id, user_id AS document_id, CAST(floor(value) AS BIGINT) % 10 AS priority, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status, event_type AS key, ts, event_id % 5 + 1 AS attempts FROM events)"


def jobs(spark, sf_dir):
    """The event log as jobs."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), (F.floor("value") % 10).alias("priority"), status.alias("status"), F.col("event_type").alias("key"), "ts", (F.col("event_id") % 5 + 1).alias("attempts"))


@query(f"WITH {_JOBS} SELECT status, count(*) AS n, min(job_id) AS oldest, count(DISTINCT document_id) AS documents FROM j GROUP BY 1")
def queue_stats(spark, sf_dir):
    """A17."""
    return jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("job_id").alias("oldest"), F.count_distinct("document_id").alias("documents"))


@query(f"WITH {_JOBS} SELECT document_id, count(*) AS n FROM j WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1")
def duplicate_jobs(spark, sf_dir):
    """A18."""
    return jobs(spark, sf_dir).where("status in ('pending', 'running')").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_JOBS} SELECT document_id, min(priority) AS priority, count(*) AS requests, min(job_id) AS job_id FROM j GROUP BY 1")
def coalesce_jobs(spark, sf_dir):
    """R4, A27."""
    return queue.coalesce_jobs(jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT key, job_id, document_id, priority FROM j WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, job_id) = 1")
def queue_claims(spark, sf_dir):
    """T7."""
    return queue.claims(jobs(spark, sf_dir), "key")


@query(f"WITH {_JOBS}, a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY job_id) AS nth FROM j WHERE status IN ('pending', 'running')) SELECT job_id, document_id FROM a WHERE nth = 1 AND status = 'pending' AND priority < 8")
def fifo_claims(spark, sf_dir):
    """No earlier active job of the key, and due."""
    j = jobs(spark, sf_dir).select("job_id", F.col("document_id").alias("key"), "status", (F.col("priority") < 8).alias("due"))
    return queue.fifo_claims(j).select("job_id", F.col("key").alias("document_id"))


@query(f"WITH {_JOBS}, n AS (SELECT max(ts) AS now FROM j) SELECT CASE WHEN status = 'running' AND epoch(now) - epoch(ts) > 86400 THEN 'pending' ELSE status END AS status, count(*) AS n FROM j, n GROUP BY 1")
def stale_recovery(spark, sf_dir):
    """A day without a sign of life; now is the log's end."""
    j = jobs(spark, sf_dir)
    now = F.broadcast(j.agg(F.max("ts").alias("now")))
    return queue.recover(j.crossJoin(now), F.col("now"), 86400).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JOBS} SELECT job_id, attempts, CASE WHEN attempts >= 4 THEN 'dead' ELSE 'retry' END AS state, CASE WHEN attempts < 4 THEN CAST(30 * pow(2, attempts - 1) AS BIGINT) END AS delay FROM j WHERE status = 'failed'")
def retry_backoff(spark, sf_dir):
    """R9."""
    return queue.after_failure(jobs(spark, sf_dir).where("status = 'failed'"), 4, 30)


@query(f"WITH {_JOBS} SELECT job_id, key, status FROM j QUALIFY status <> 'done' OR row_number() OVER (PARTITION BY key, status ORDER BY job_id DESC) <= 5")
def job_retention(spark, sf_dir):
    """Finished jobs beyond the newest of their key go."""
    return queue.retain(jobs(spark, sf_dir), 5, "key").select("job_id", "key", "status")


DOCUMENT_CAP = 6000  # characters of one document, the feature's default
_REC = f"{_BM25}, rec AS (SELECT query_id, rank, document_id, substr(content, 1, {DOCUMENT_CAP}) AS text FROM lex JOIN corpus USING (document_id))"


def records(spark, sf_dir, cap: int = DOCUMENT_CAP):
    """The hits of each query with their texts, each up to the cap of one document."""
    d = corpus(spark, sf_dir).select("document_id", F.substring("content", 1, cap).alias("text"))
    return lexical_hits(spark, sf_dir).select("query_id", F.col("rank").cast("long"), "document_id").join(d, "document_id")


@query(f"""WITH {_REC}, u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM rec)
SELECT query_id, rank, document_id, CAST(least(length(text), 20000 - used) AS BIGINT) AS kept, least(length(text), 20000 - used) < length(text) AS cut FROM u WHERE 20000 - used >= length(text) OR 20000 - used >= 200""")
def prefix_pack(spark, sf_dir):
    """Leading records within the budget, each document within its cap, the last one cut."""
    return pack.prefix_pack(records(spark, sf_dir), 20_000, 200)


@query(f"WITH {_REC} SELECT query_id, rank, document_id, least(length(text), 20000 // count(*) OVER (PARTITION BY query_id)) AS kept FROM rec")
def fair_share_pack(spark, sf_dir):
    """P3."""
    return pack.fair_share(records(spark, sf_dir), 20_000)


@query()
def json_pack(spark, sf_dir):
    """Exact JSON size."""
    return pack.fit_json(records(spark, sf_dir), 12_000).select("query_id", "n_records", "size", F.md5("payload").alias("payload"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, sum(length(text)) AS n_chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
def chat_rollup(spark, sf_dir):
    """Our own roll-up of conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("n_chars"), F.max("turn").alias("last_turn"))


@query("""SELECT d.doc_id, l.quality, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'uncertain' WHEN l.quality = 1 THEN 'match' ELSE 'reject' END AS verdict,
  CASE WHEN l.quality = 1 AND NOT regexp_matches(d.text, '(19|20)[0-9]{2}') THEN 'uncertain' ELSE CASE WHEN l.quality = 1 THEN 'match' ELSE 'reject' END END AS year_verdict FROM labels l JOIN documents d USING (doc_id)""")
def verdict_audit(spark, sf_dir):
    """labels as verdicts; a match that isn't direct, or lacks the year, is uncertain."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    good = F.col("quality") == 1
    return j.select(
        "doc_id",
        "quality",
        F.when(good & (F.col("toxic") == 1), "uncertain").when(good, "match").otherwise("reject").alias("verdict"),
        F.when(good & ~F.col("text").rlike("(19|20)[0-9]{2}"), "uncertain").when(good, "match").otherwise("reject").alias("year_verdict"),
    )


_FIND = """
fd AS (SELECT l_orderkey AS run_id, l_orderkey || ':' || l_linenumber AS finding_id, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'open' END AS state, l_partkey AS entity_id, l_suppkey AS document_id FROM lineitem)
"""


def findings(spark, sf_dir):
    """Order lines as findings of a run: their order, state, entity and document."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    state = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("open")
    return l.select(F.col("l_orderkey").alias("run_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("finding_id"), state.alias("state"), F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("document_id"))


@query(f"WITH {_FIND} SELECT run_id, count(*) AS findings, count(*) FILTER (WHERE state = 'open') AS open, CASE WHEN count(*) FILTER (WHERE state = 'open') > 0 THEN 'open' WHEN count(*) FILTER (WHERE state = 'accepted') > 0 THEN 'curated' ELSE 'dismissed' END AS status FROM fd GROUP BY 1")
def run_status(spark, sf_dir):
    """A22."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    r = findings(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), is_("open").alias("open"), is_("accepted").alias("accepted"))
    return r.select("run_id", "findings", "open", F.when(F.col("open") > 0, "open").when(F.col("accepted") > 0, "curated").otherwise("dismissed").alias("status"))


@query(f"WITH {_FIND}, v AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT finding_id, p_name AS entity, s_name AS document FROM fd LEFT JOIN part ON entity_id = p_partkey LEFT JOIN supplier ON document_id = s_suppkey WHERE document_id IN (FROM v)")
def visible_findings(spark, sf_dir):
    """Findings of permitted documents, with their entity and document."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    f = findings(spark, sf_dir).join(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("document_id")), "document_id", "left_semi")
    named = f.join(p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("entity")), "entity_id", "left")
    return named.join(s.select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("document")), "document_id", "left").select("finding_id", "entity", "document")


@query(f"WITH {_FIND} SELECT entity_id, state, finding_id FROM fd WHERE state <> 'open' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY finding_id DESC) = 1")
def latest_decision(spark, sf_dir):
    """The last decision of each entity counts."""
    d = findings(spark, sf_dir).where("state <> 'open'")
    return d.groupBy("entity_id").agg(F.max_by("state", "finding_id").alias("state"), F.max("finding_id").alias("finding_id"))


@query("""WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS new FROM part)
SELECT new AS entity_id, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN m ON l_partkey = old GROUP BY 1""")
def merge_entities(spark, sf_dir):
    """M7: edges of merged entities go to the one that stays."""
    p = table(spark, sf_dir, "part")
    m = p.join(p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("new")), ["p_brand", "p_size"]).select("p_partkey", "new")
    e = table(spark, sf_dir, "lineitem").join(m, F.col("l_partkey") == F.col("p_partkey"))
    return e.groupBy(F.col("new").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT document_id, subject, object, confidence, FALSE AS manual FROM (SELECT l_orderkey AS document_id, l_suppkey AS subject, l_partkey AS object, l_discount AS confidence FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber > 1)
UNION ALL SELECT l_orderkey, l_suppkey, l_partkey, l_tax, l_linenumber = 1 FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 3 <> 0""")
def replace_observations(spark, sf_dir):
    """Observations of reindexed documents are replaced, manual ones stay."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ids = ("l_orderkey as document_id", "l_suppkey as subject", "l_partkey as object")
    old = l.selectExpr(*ids, "l_tax as confidence", "l_linenumber = 1 as manual")
    new = l.where("l_orderkey % 3 = 0 and l_linenumber > 1").selectExpr(*ids, "l_discount as confidence", "false as manual")
    touched = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey as document_id", "true as touched")
    stays = old.join(touched, "document_id", "left").where("touched is null or manual").drop("touched")
    return stays.unionByName(new)


@query("SELECT user_id, min(value) AS priority, count(*) AS requests, min(event_id) AS job_id FROM events GROUP BY 1")
def stream_coalesce(spark, sf_dir):
    """The coalescing queue as a stream."""
    return worker.run_available(worker.coalesced_jobs(worker.stream(spark, sf_dir, "events")), "complete")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_filter(spark, sf_dir):
    """An append-only worker."""
    return worker.run_available(worker.stream(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Our extension: hourly windows, in one batch the same as in a stream."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
