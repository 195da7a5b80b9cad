"""Duplicates, entities, relations, identities and components."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalogue.registry import area
from lodestar.catalogue.retrieval import _BM25, lexical_hits
from lodestar.functions import text
from lodestar.operators import components as cc
from lodestar.operators import dedup, graph, identities
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()

_OBS = """
obs AS (SELECT 'O' || l_orderkey AS document_id, 'S' || l_suppkey AS subject, 'SUPPLIES' AS predicate, 'C' || o_custkey AS object, l_discount * 10 AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
men AS (SELECT document_id, e AS entity_id, count(*) AS mentions FROM (SELECT document_id, subject AS e FROM obs UNION ALL SELECT document_id, object FROM obs) GROUP BY ALL),
ask(entity_id) AS (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 9000)
"""


def observations(spark, sf_dir):
    """Order lines as relation observations: a supplier supplies a customer, stated by an order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return lines.select(named("O", "l_orderkey").alias("document_id"), named("S", "l_suppkey").alias("subject"), F.lit("SUPPLIES").alias("predicate"), named("C", "o_custkey").alias("object"), (F.col("l_discount") * 10).alias("confidence"))


def mentions(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.select("document_id", F.explode(F.array("subject", "object")).alias("entity_id")).groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("mentions"))


def asked(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return s.unionByName(table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id")))


@query(f"WITH {_OBS} SELECT subject, object, predicate, count(*) AS n, round(max(confidence), 6) AS confidence FROM obs WHERE subject IN (FROM ask) AND object IN (FROM ask) GROUP BY ALL")
def direct_relations(spark, sf_dir):
    """J14."""
    return graph.direct_relations(observations(spark, sf_dir), asked(spark, sf_dir))


@query(f"WITH {_OBS} SELECT document_id, count(*) AS n, round(max(confidence), 6) AS confidence FROM obs WHERE subject IN (FROM ask) AND object IN (FROM ask) GROUP BY ALL")
def observed_documents(spark, sf_dir):
    """J15, A9."""
    return graph.observed_documents(observations(spark, sf_dir), asked(spark, sf_dir))


def supplier_pairs(spark, sf_dir):
    """Suppliers 1 and 2, 3 and 4, ... as pairs: (pair_id, side, entity_id)."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.floor((k + 1) / 2).alias("pair_id"), F.when(k % 2 == 1, "a").otherwise("b").alias("side"), F.concat(F.lit("S"), k.cast("string")).alias("entity_id"))


_PAIRS = "pr AS (SELECT (s_suppkey + 1) // 2 AS pair_id, s_suppkey % 2 AS side, 'S' || s_suppkey AS entity_id FROM supplier)"


@query(f"""WITH {_OBS}, {_PAIRS}, f AS (SELECT pair_id AS group_id, document_id, count(DISTINCT entity_id) AS entities, CAST(sum(mentions) AS BIGINT) AS mentions FROM men JOIN pr USING (entity_id) GROUP BY ALL)
SELECT f.* FROM f JOIN (SELECT pair_id AS group_id, count(*) AS entities FROM pr GROUP BY 1) n USING (group_id, entities)""")
def mentioning_all(spark, sf_dir):
    """For every pair of suppliers the documents that mention both."""
    return graph.mentioning_all(mentions(spark, sf_dir), supplier_pairs(spark, sf_dir).select(F.col("pair_id").alias("group_id"), "entity_id"))


@query(f"""WITH {_OBS}, {_PAIRS}, m AS (SELECT pair_id, object AS bridge, min(CASE WHEN side = 1 THEN document_id END) AS document_a, count(CASE WHEN side = 1 THEN 1 END) AS n_a, min(CASE WHEN side = 0 THEN document_id END) AS document_b, count(CASE WHEN side = 0 THEN 1 END) AS n_b
  FROM obs JOIN pr ON subject = entity_id GROUP BY ALL) SELECT * FROM m WHERE n_a > 0 AND n_b > 0""")
def two_hop_bridge(spark, sf_dir):
    """For every pair of suppliers the customers of both."""
    return graph.bridges(observations(spark, sf_dir), supplier_pairs(spark, sf_dir)).select("pair_id", "bridge", "document_a", "n_a", "document_b", "n_b")


@query(f"""WITH {_OBS}, q AS (SELECT s_suppkey AS query_id, 'S' || s_suppkey AS a FROM supplier), t AS (
  SELECT query_id, document_id, 1.25 + max(confidence) AS score, 0 AS tier FROM q JOIN obs ON subject = a WHERE confidence > 0.95 GROUP BY ALL
  UNION ALL SELECT query_id, document_id, 1.0 + max(mentions) / 100, 1 FROM q JOIN men ON entity_id = a WHERE mentions > 1 GROUP BY ALL
  UNION ALL SELECT query_id, document_id, 0.62, 2 FROM q JOIN men ON entity_id = a GROUP BY ALL)
SELECT query_id, document_id, tier, round(score, 6) AS score FROM t JOIN (SELECT query_id, min(tier) AS tier FROM t GROUP BY 1) USING (query_id, tier)""")
def graph_ladder(spark, sf_dir):
    """Explicit observations, else documents with several mentions, else any."""
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("a"))
    obs, men = observations(spark, sf_dir), mentions(spark, sf_dir)
    by = lambda d, c, cond, score: q.join(d.where(cond), F.col(c) == F.col("a")).groupBy("query_id", "document_id").agg(score.alias("score"))
    one = by(obs, "subject", "confidence > 0.95", 1.25 + F.max("confidence"))
    two = by(men, "entity_id", "mentions > 1", 1.0 + F.max("mentions") / 100)
    three = by(men, "entity_id", "true", F.lit(0.62) + F.min("mentions") * 0)
    return graph.ladder(one, two, three).select("query_id", "document_id", "tier", F.round("score", 6).alias("score"))


@query(f"WITH {_OBS} SELECT entity_id, count(*) AS documents, sum(mentions) AS mentions FROM men GROUP BY 1")
def mention_rollup(spark, sf_dir):
    """A10."""
    return mentions(spark, sf_dir).groupBy("entity_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("mentions").alias("mentions"))


@query("""WITH f AS (SELECT 'N' || c_nationkey AS entity_id, lower(c_mktsegment) AS normalized, c_name AS value, c_acctbal AS weight FROM customer)
SELECT entity_id, normalized, value, weight FROM f QUALIFY row_number() OVER (PARTITION BY entity_id, normalized ORDER BY weight DESC, value) = 1""")
def strongest_forms(spark, sf_dir):
    """A11, A13, W7."""
    f = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.lower("c_mktsegment").alias("normalized"), F.col("c_name").alias("value"), F.col("c_acctbal").alias("weight"))
    order = Window.partitionBy("entity_id", "normalized").orderBy(F.desc("weight"), "value")
    return f.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


_SAME = """e AS (SELECT a.c_custkey AS a, min(b.c_custkey) AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.c_custkey > a.c_custkey AND b.c_custkey <= a.c_custkey + 40 GROUP BY 1)"""


def same_as(spark, sf_dir):
    """Confirmed equivalences: each customer with the next one, within 40 keys, of its nation and segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), "c_nationkey", "c_mktsegment")
    following = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("a")
    return c.withColumn("b", F.lead("a").over(following)).where("b is not null and b <= a + 40").select("a", "b")


@query(f"""WITH RECURSIVE {_SAME}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON r.seen = u.x)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def same_as_components(spark, sf_dir):
    """Components without blocks; see confirmed_components."""
    return cc.components(same_as(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SAME}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS seen, 0 AS d FROM u UNION SELECT r.node, u.y, d + 1 FROM r JOIN u ON r.seen = u.x WHERE d < 2)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def same_as_two_hops(spark, sf_dir):
    """A bounded walk."""
    return cc.components(same_as(spark, sf_dir), hops=2)


@query()
def identity_suggestions(spark, sf_dir):
    """Profiles of one nation and segment (the blocking key) by name, and balances of one thousand as more evidence, from 0.5 on.

    Without the balances only equal names and names with equal ends reach 0.5, so the pairs are those of one thousand and those of equal ends.
    """
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", text.folded_name("c_name").alias("name"), F.round("c_acctbal", -3).alias("band"))
    return identities.suggestions(c.where("name is not null"), "c_nationkey", "c_mktsegment").where("score >= 0.5")


@query(f"WITH {CORPUS} SELECT content_hash, count(*) AS n, min(doc_id) AS first FROM corpus GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    """D6, D10, A18."""
    docs = corpus(spark, sf_dir).select(dedup.trusted_hash(F.col("content_hash")).alias("content_hash"), "doc_id")
    return docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(rf"""WITH {CORPUS}, s AS (SELECT document_id, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS dir, regexp_extract(path, '([^/]*)$', 1) AS f FROM corpus),
t AS (SELECT document_id, dir, regexp_replace(lower(regexp_replace(f, '\.[^.]*$', '')), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS stem, lower(regexp_extract(f, '^.+\.([^.]+)$', 1)) AS suffix FROM s)
SELECT a.document_id AS a, b.document_id AS b FROM t a JOIN t b ON a.dir = b.dir AND a.stem = b.stem AND a.suffix <> b.suffix AND a.document_id < b.document_id
WHERE a.suffix IN ('odt', 'pdf', 'doc', 'docx', 'rtf', 'txt', 'md', 'html') AND b.suffix IN ('odt', 'pdf', 'doc', 'docx', 'rtf', 'txt', 'md', 'html')""")
def filename_variants(spark, sf_dir):
    """D3, D4, D5."""
    s = corpus(spark, sf_dir).select("document_id", dedup.file_signature(F.col("path")).alias("s")).where("s is not null")
    side = lambda n: s.select(F.col("document_id").alias(n), F.col("s.dir").alias("dir"), F.col("s.stem").alias("stem"), F.col("s.suffix").alias(f"suffix_{n}"))
    return side("a").join(side("b"), ["dir", "stem"]).where("suffix_a <> suffix_b and a < b").select("a", "b")


def pools(spark, sf_dir):
    """Rankings with what the duplicate tests need."""
    d = corpus(spark, sf_dir).select("document_id", dedup.trusted_hash(F.col("content_hash")).alias("hash"), dedup.file_signature(F.col("path")).alias("s"), text.comparable(F.col("content")).alias("text"))
    return lexical_hits(spark, sf_dir).select("query_id", "document_id", "rank").join(d, "document_id").select("query_id", "document_id", "rank", "hash", "s.dir", "s.stem", "s.suffix", "text")


@query()
def arm_dedup(spark, sf_dir):
    """Greedy variant groups of each ranking."""
    return dedup.group_variants(pools(spark, sf_dir)).select("query_id", "document_id", "rank", F.size("variants").alias("variants"))


@query(f"""WITH {_BM25}, g AS (SELECT query_id, content_hash AS group_id, document_id, rank, owner FROM lex JOIN corpus USING (document_id))
SELECT query_id, group_id, arg_min(document_id, rank) AS document_id, min(rank) AS position FROM g WHERE owner <> 'user3' GROUP BY ALL""")
def promote_authorized(spark, sf_dir):
    """F16: the first permitted member stands for its group."""
    d = corpus(spark, sf_dir).select("document_id", F.col("content_hash").alias("group_id"), "owner")
    groups = lexical_hits(spark, sf_dir).join(d, "document_id").select("query_id", "group_id", "document_id", F.col("rank").cast("long").alias("position"))
    return dedup.promote_authorized(groups, d.where("owner <> 'user3'").select("document_id"))


@query("""WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS mention, c_name AS name, c_acctbal / 10000 AS confidence FROM customer), r AS (SELECT mention, name, confidence, row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, name) AS k,
  lead(confidence) OVER (PARTITION BY mention ORDER BY confidence DESC, name) AS next FROM c)
SELECT mention, name, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.95 AND confidence - coalesce(next, 0) >= 0.1 OR confidence >= 0.9 AND next IS NULL THEN 'resolved' WHEN confidence > 0 THEN 'candidates' ELSE 'unresolved' END AS status FROM r WHERE k = 1""")
def resolver_merge(spark, sf_dir):
    """The best candidate of each mention and whether it settles it."""
    c = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("mention"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000).alias("confidence"))
    order = Window.partitionBy("mention").orderBy(F.desc("confidence"), "name")
    r = c.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order)).where("k = 1")
    sure = ((F.col("confidence") >= 0.95) & (F.col("confidence") - F.coalesce("next", F.lit(0.0)) >= 0.1)) | ((F.col("confidence") >= 0.9) & F.col("next").isNull())
    status = F.when(sure, "resolved").when(F.col("confidence") > 0, "candidates").otherwise("unresolved")
    return r.select("mention", "name", F.round("confidence", 6).alias("confidence"), status.alias("status"))


@query("""WITH l AS (SELECT lower(c_name) AS mention, 'local' AS source, c_acctbal > 0 AS resolved FROM customer), x AS (SELECT lower(s_name) AS mention, 'external' AS source, s_acctbal > 0 AS resolved FROM supplier UNION ALL SELECT lower(c_name), 'external', TRUE FROM customer WHERE c_acctbal < 1000)
SELECT coalesce(l.mention, x.mention) AS mention, CASE WHEN l.resolved OR x.mention IS NULL THEN 'local' ELSE 'external' END AS source FROM l FULL JOIN x ON l.mention = x.mention""")
def merge_contexts(spark, sf_dir):
    """Resolved local entities win over external ones."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    local = c.select(F.lower("c_name").alias("mention"), (F.col("c_acctbal") > 0).alias("resolved"))
    outer = s.select(F.lower("s_name").alias("mention")).unionByName(c.where("c_acctbal < 1000").select(F.lower("c_name").alias("mention"))).withColumn("outer", F.lit(True))
    both = local.join(outer, "mention", "full")
    return both.select("mention", F.when(F.coalesce("resolved", F.lit(False)) | F.col("outer").isNull(), "local").otherwise("external").alias("source"))


@query("""WITH f AS (SELECT lower(c_mktsegment) || ' ' || c_nationkey AS normalized, 'C' || c_custkey AS entity_id, c_custkey % 5 = 0 AS preferred FROM customer),
d AS (SELECT normalized, min(CASE WHEN preferred THEN entity_id END) AS decided, count(DISTINCT CASE WHEN preferred THEN entity_id END) AS n_decided, count(DISTINCT entity_id) AS n, min(entity_id) AS one FROM f GROUP BY 1)
SELECT normalized, CASE WHEN n_decided = 1 THEN decided WHEN n_decided = 0 AND n = 1 THEN one END AS entity_id FROM d""")
def unique_forms(spark, sf_dir):
    """A decided form wins, else a form that only one entity has."""
    c = table(spark, sf_dir, "customer").select(F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("normalized"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"), (F.col("c_custkey") % 5 == 0).alias("preferred"))
    chosen = F.when(F.col("preferred"), F.col("entity_id"))
    d = c.groupBy("normalized").agg(F.min(chosen).alias("decided"), F.count_distinct(chosen).alias("n_decided"), F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"))
    return d.select("normalized", F.when(F.col("n_decided") == 1, F.col("decided")).when((F.col("n_decided") == 0) & (F.col("n") == 1), F.col("one")).alias("entity_id"))


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'email:' || (c_custkey // 2) END AS email, CASE WHEN c_custkey % 3 = 0 THEN 'phone:' || (c_custkey // 6) END AS phone FROM customer),
e AS (SELECT email, min(c_custkey) AS id FROM k WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) = 2), p AS (SELECT phone, min(c_custkey) AS id FROM k WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) = 2)
SELECT c_custkey, coalesce(e.id, p.id, c_custkey) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'email' WHEN p.id IS NOT NULL THEN 'phone' ELSE 'new' END AS basis FROM k LEFT JOIN e USING (email) LEFT JOIN p USING (phone)""")
def resolve_or_create(spark, sf_dir):
    """M1: the first rung of the ladder with exactly one counterpart decides."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat(F.lit("email:"), F.floor(F.col("c_custkey") / 2).cast("string"))).alias("email"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("phone:"), F.floor(F.col("c_custkey") / 6).cast("string"))).alias("phone"))
    rung = lambda k: c.where(f"{k} is not null").groupBy(k).agg(F.min("c_custkey").alias(f"{k}_id"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    r = c.join(rung("email"), "email", "left").join(rung("phone"), "phone", "left")
    basis = F.when(F.col("email_id").isNotNull(), "email").when(F.col("phone_id").isNotNull(), "phone").otherwise("new")
    return r.select("c_custkey", F.coalesce("email_id", "phone_id", "c_custkey").alias("entity_id"), basis.alias("basis"))


@query("""SELECT 'nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'order', count(*) FROM orders""")
def graph_totals(spark, sf_dir):
    """A14."""
    out = None
    for kind, name in (("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"), ("order", "orders")):
        part = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out
