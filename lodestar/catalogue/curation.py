"""Curation of the entity graph, workers and their cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalogue.knowledge import _SAME, same_as
from lodestar.catalogue.operations import _JOBS, jobs
from lodestar.catalogue.registry import area
from lodestar.functions import chunks, embedding
from lodestar.operators import components as cc
from lodestar.operators import curation
from lodestar.sources.corpus import corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()


@query("""WITH k AS (SELECT 'N' || n_regionkey AS parent, lower(n_name) AS normalized, min('U' || n_nationkey) AS unit_id, min(n_name) AS name FROM nation WHERE n_nationkey % 2 = 0 GROUP BY ALL),
s AS (SELECT 'N' || n_regionkey AS parent, lower(trim(x)) AS normalized, min(trim(x)) AS stated FROM (SELECT n_regionkey, unnest([' ' || upper(n_name), n_name || ' office', ' ']) AS x FROM nation) WHERE trim(x) <> '' GROUP BY ALL)
SELECT coalesce(k.parent, s.parent) AS parent, coalesce(k.normalized, s.normalized) AS normalized, coalesce(unit_id, 'unit:' || substr(sha256(s.parent || chr(0) || s.normalized), 1, 16)) AS unit_id, coalesce(name, stated) AS name, unit_id IS NULL AS created
FROM k FULL JOIN s ON k.parent = s.parent AND k.normalized = s.normalized""")
def organisation_units(spark, sf_dir):
    """M3: units of a parent organisation, found by name or made."""
    n = table(spark, sf_dir, "nation")
    parent = F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("parent")
    known = n.where("n_nationkey % 2 = 0").select(parent, F.col("n_name").alias("name"), F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("unit_id"))
    stated = n.select(parent, F.explode(F.array(F.concat(F.lit(" "), F.upper("n_name")), F.concat("n_name", F.lit(" office")), F.lit(" "))).alias("name"))
    return curation.units(known, stated)


@query("""WITH c AS (SELECT c_custkey AS contact_id, 'E' || c_custkey % 500 AS entity_id FROM customer WHERE NOT (c_acctbal < 0 OR c_custkey % 500 < 20)), n AS (SELECT entity_id, count(*) AS n FROM c GROUP BY 1),
e AS (SELECT DISTINCT 'E' || c_custkey % 500 AS entity_id FROM customer), m AS (SELECT DISTINCT 'E' || o_custkey % 500 AS entity_id FROM orders WHERE o_custkey % 5 = 0)
SELECT e.entity_id, coalesce(n, 0) AS contacts, CASE WHEN n IS NOT NULL OR m.entity_id IS NOT NULL THEN 'active' ELSE 'orphan' END AS status FROM e LEFT JOIN n ON e.entity_id = n.entity_id LEFT JOIN m ON e.entity_id = m.entity_id""")
def removed_contacts(spark, sf_dir):
    """Contacts go; entities that neither a contact nor a mention supports are orphans."""
    entity = lambda c: F.concat(F.lit("E"), (F.col(c) % 500).cast("string")).alias("entity_id")
    c = table(spark, sf_dir, "customer")
    contacts = c.select(F.col("c_custkey").alias("contact_id"), entity("c_custkey"))
    gone = c.where("c_acctbal < 0 or c_custkey % 500 < 20").select(F.col("c_custkey").alias("contact_id"))
    return curation.removed_contacts(contacts.select("entity_id").distinct(), contacts, gone, table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(entity("o_custkey")))


@query("""WITH d AS (SELECT l_partkey AS p, l_orderkey * 10 + l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'R' THEN 'delete' ELSE 'confirm' END AS action, CASE WHEN l_linenumber > 1 THEN 'name ' || l_suppkey END AS v FROM lineitem WHERE l_suppkey % 4 = 0),
l AS (SELECT p, arg_max(action, n) AS action, arg_max(coalesce(v, ''), n) AS v FROM d GROUP BY 1)
SELECT p_partkey, CASE WHEN action = 'correct' AND v <> '' THEN v ELSE p_name END AS p_name FROM part LEFT JOIN l ON p = p_partkey WHERE action IS NULL OR action <> 'delete'""")
def corrected_names(spark, sf_dir):
    """The last decision about a name corrects it, takes it away or leaves it."""
    action = F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "R", "delete").otherwise("confirm")
    new = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("name "), F.col("l_suppkey").cast("string")))
    log = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 = 0").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), action.alias("action"), new.alias("new_value"))
    return curation.corrected(table(spark, sf_dir, "part").select("p_partkey", "p_name"), log, "p_partkey", "p_name")


@query("""WITH f AS (SELECT c_custkey AS form_id, CASE c_custkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'merged_name' ELSE 'alias' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN ' ' END AS policy FROM customer),
g AS (SELECT o_custkey AS form_id, arg_max(CASE o_orderkey % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'contextual' WHEN 2 THEN 'exclusive' ELSE 'add' END, o_orderkey) AS action FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT f.form_id, kind, CASE WHEN action IN ('exclusive', 'contextual') THEN action WHEN trim(policy) <> '' THEN policy WHEN kind = 'name' THEN 'exclusive' ELSE 'contextual' END AS policy FROM f LEFT JOIN g ON f.form_id = g.form_id WHERE action IS NULL OR action <> 'remove'""")
def form_policies(spark, sf_dir):
    """Policies of names and aliases, filled where they lack, after additions, removals and changes."""
    k = F.col("c_custkey")
    forms = table(spark, sf_dir, "customer").select(k.alias("form_id"), F.when(k % 3 == 0, "name").when(k % 3 == 1, "merged_name").otherwise("alias").alias("kind"), F.when(k % 4 == 0, "blocked").when(k % 4 == 1, " ").alias("policy"))
    action = F.element_at(F.array(*map(F.lit, ("remove", "contextual", "exclusive", "add"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return curation.form_policies(forms, table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("form_id"), F.col("o_orderkey").alias("at"), action.alias("action")))


@query("""WITH f AS (SELECT l_partkey || ':' || l_suppkey AS finding_id, l_returnflag AS v, l_linestatus AS b, md5(CAST(l_partkey % 100 AS VARCHAR)) AS h, l_discount AS score FROM lineitem),
k AS (SELECT finding_id, max(score) AS score, arg_max(h, {'s': score, 'h': h}) AS h FROM f WHERE v = 'N' AND b = 'O' GROUP BY 1), c AS (SELECT md5(CAST(p_partkey % 100 AS VARCHAR)) AS h, max(CASE p_size % 2 WHEN 0 THEN 'accepted' ELSE 'rejected' END) AS d FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)
SELECT finding_id, score, coalesce(d, 'pending') AS disposition, d IS NOT NULL AS reused FROM k LEFT JOIN c ON k.h = c.h""")
def stored_findings(spark, sf_dir):
    """Only direct matches are stored; what curators said about the same question is taken over."""
    hashed = lambda c: F.md5((F.col(c) % 100).cast("string")).alias("curation_hash")
    verdict, binding = F.when(F.col("l_returnflag") == "N", "match").otherwise("reject"), F.when(F.col("l_linestatus") == "O", "direct").otherwise("indirect")
    found = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("finding_id"), verdict.alias("verdict"), binding.alias("binding"), hashed("l_partkey"), F.col("l_discount").alias("score"))
    known = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(hashed("p_partkey"), F.when(F.col("p_size") % 2 == 0, "accepted").otherwise("rejected").alias("disposition"))
    return curation.stored_findings(found, known)


@query("""SELECT o_orderkey AS finding_id, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AND o_orderstatus <> 'F' THEN 'suppressed' ELSE 'status_' || o_orderstatus END AS status FROM orders""")
def suppressed_findings(spark, sf_dir):
    """Open findings without any entity leave the curators' queue; closed ones stay as they are."""
    named = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("named")).distinct()
    o = table(spark, sf_dir, "orders").join(named, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("named").isNull() & (F.col("o_orderstatus") != "F"), "suppressed").otherwise(F.concat(F.lit("status_"), F.col("o_orderstatus"))).alias("status"))


@query("""WITH d AS (SELECT s_suppkey AS user_id FROM supplier WHERE s_acctbal < 0) SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_suppkey IN (FROM d) AND l_returnflag = 'N')""")
def purged_findings(spark, sf_dir):
    """Uncurated findings of denied documents go, curated ones stay."""
    denied = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit("N").alias("l_returnflag"))
    return table(spark, sf_dir, "lineitem").join(denied, ["l_suppkey", "l_returnflag"], "left_anti").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey AS run_id, l_linenumber, CASE WHEN o_orderpriority LIKE '1%' AND l_returnflag = 'N' THEN 'dismissed' WHEN l_returnflag = 'N' THEN 'pending' ELSE 'curated' END AS disposition FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def dismissed_runs(spark, sf_dir):
    """Dismissing a run dismisses its pending findings only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").startswith("1").alias("dismissed"))
    l = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")  # noqa: E741
    pending = F.col("l_returnflag") == "N"
    return l.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.when(pending & F.col("dismissed"), "dismissed").when(pending, "pending").otherwise("curated").alias("disposition"))


@query("""WITH m AS (SELECT DISTINCT 'S' || l_suppkey AS id FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'A')
SELECT 'S' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 'key' || s_suppkey ELSE nullif(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), '') END AS identity_key, CASE WHEN m.id IS NOT NULL AND s_suppkey % 5 <> 0 THEN 'confirmed' WHEN s_suppkey % 5 = 0 THEN 'merged' ELSE 'open' END AS status FROM supplier LEFT JOIN m ON m.id = 'S' || s_suppkey""")
def backfilled_entities(spark, sf_dir):
    """Identity keys and confirmations that older states lack."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    entities = s.select(F.concat(F.lit("S"), k.cast("string")).alias("entity_id"), F.when(k % 3 == 0, F.concat(F.lit("key"), k.cast("string"))).alias("identity_key"), F.when(k % 5 == 0, "merged").otherwise("open").alias("status"), "s_name")
    merged = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("kept"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("rule").alias("method"))
    return curation.backfilled(entities, merged, F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", " "))


@query("""WITH b AS (SELECT user_id % 20 AS account, event_type AS mailbox, ts AS at, event_id, CASE WHEN event_id % 1000 > 500 THEN 2 ELSE 1 END AS v, CASE WHEN event_id % 3 = 0 THEN 'backfill' ELSE 'live' END AS kind, event_id AS low, event_id + 5 AS high FROM events),
n AS (SELECT account, mailbox, arg_max(v, event_id) AS v FROM b GROUP BY ALL)
SELECT b.account, b.mailbox, b.v AS uidvalidity, max(CASE WHEN kind = 'live' THEN high END) AS live_uid, min(low) AS backfill_before_uid FROM b JOIN n ON b.account = n.account AND b.mailbox = n.mailbox AND b.v = n.v GROUP BY ALL""")
def mail_cursors(spark, sf_dir):
    """Cursors of mailboxes, up for new mail and down for old; another uidvalidity starts them anew."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    b = e.select((F.col("user_id") % 20).alias("account"), F.col("event_type").alias("mailbox"), i.alias("at"), F.when(i % 1000 > 500, 2).otherwise(1).alias("uidvalidity"), F.when(i % 3 == 0, "backfill").otherwise("live").alias("kind"), i.alias("low"), (i + 5).alias("high"))
    return curation.cursors(b)


@query("""WITH e AS (SELECT event_id, ts, user_id % 9 <> 0 AS active, CASE WHEN event_id % 4 <> 0 THEN ts - to_seconds(event_id % 1200) END AS last FROM events)
SELECT event_id, CASE WHEN NOT active THEN 'stopped' WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'quiet' WHEN last IS NOT NULL AND floor(epoch(ts)) - floor(epoch(last)) < 600 THEN 'busy' ELSE 'run' END AS state FROM e""")
def worker_gates(spark, sf_dir):
    """Whether a worker may run: not stopped, outside quiet hours, and the service idle for ten minutes."""
    e = table(spark, sf_dir, "events")
    last = F.when(F.col("event_id") % 4 != 0, F.expr("ts - make_dt_interval(0, 0, 0, event_id % 1200)"))
    return e.select("event_id", curation.may_run(F.col("ts"), F.col("user_id") % 9 != 0, 22, 6, last, 600).alias("state"))


@query(f"""WITH {_JOBS}, f AS (SELECT job_id, key, attempts FROM j WHERE status = 'failed') SELECT key, count(*) AS dead, min(job_id) AS first, max(attempts) AS attempts FROM f WHERE attempts >= 4 GROUP BY 1""")
def dead_letters(spark, sf_dir):
    """K6: what failed too often, as JSON lines of the dead-letter table, summed up by key after reading them back."""
    dead = jobs(spark, sf_dir).where("status = 'failed' and attempts >= 4").select(F.to_json(F.struct("job_id", "key", "attempts")).alias("line"))
    read = dead.select(F.from_json("line", "job_id long, key string, attempts long").alias("r")).select("r.*")
    return read.groupBy("key").agg(F.count(F.lit(1)).alias("dead"), F.min("job_id").alias("first"), F.max("attempts").alias("attempts"))


@query(f"""WITH RECURSIVE {_SAME}, no AS (SELECT a, b FROM e WHERE a % 3 = 0), act AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 11 <> 0),
g AS (SELECT a, b FROM e WHERE (a, b) NOT IN (FROM no) AND a IN (FROM act) AND b IN (FROM act)), u AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), r AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON r.seen = u.x)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def confirmed_components(spark, sf_dir):
    """Components of active entities; pairs declared different are no links."""
    same = same_as(spark, sf_dir)
    active = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("entity_id"))
    return cc.components(curation.blocked_components(same, same.where("a % 3 = 0"), active))


@query("""SELECT l_partkey AS entity_id, 'register' AS source, count(*) AS facts, count(DISTINCT l_suppkey) AS roles, max(l_shipdate) AS since FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1""")
def register_facts(spark, sf_dir):
    """Facts and roles of a register, stored by entity whatever order and repeats they come in."""
    r = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("holder"), F.col("l_orderkey").alias("register"), F.col("l_linenumber").alias("entry"), F.col("l_shipdate").alias("since"))
    delivered = r.withColumn("delivery", F.lit(1)).unionByName(r.where("holder % 2 = 0").withColumn("delivery", F.lit(2)))
    return curation.stored_facts(delivered, "entity_id", "holder", "since").select("entity_id", F.lit("register").alias("source"), "facts", "roles", "since")


@query("""WITH a AS (SELECT o_custkey AS document_id, o_orderkey AS n, o_orderstatus AS state, o_totalprice AS score FROM orders) SELECT document_id, max(n) AS last, arg_max(state, n) AS state, arg_max(score, n) AS score, count(*) AS versions FROM a GROUP BY 1""")
def stored_analyses(spark, sf_dir):
    """The newest analysis of each document stands; earlier ones are counted."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("score"))
    n = a.groupBy("document_id").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("versions"))
    return curation.latest(a, "document_id", "at", "state", "score").join(n, "document_id")


def embedded(spark, sf_dir, most: int = 600):
    pieces = corpus(spark, sf_dir).where("doc_id % 100 = 0 and content is not null").select("document_id", F.explode(chunks.search_chunks("content")).alias("c")).select("document_id", "c.chunk_no", "c.text")
    return embedding.resilient(pieces, embedding.limited(most), batch_size=16, overlap=200)


@query()
def resilient_embedding(spark, sf_dir):
    """Chunks that the model refuses are embedded in halves; batches that fail are bisected first."""
    return embedded(spark, sf_dir).select("document_id", "chunk_no", "part", F.md5("text").alias("text"), F.element_at("vector", 1).alias("size"))
