"""Scalar functions, generators and parsers over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalogue.registry import area
from lodestar.functions import chunks, dates, text
from lodestar.sources import mail, pages
from lodestar.sources.corpus import CORPUS, corpus
from lodestar.sources.tables import table

query, QUERIES, ORACLE = area()
_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query(r"""SELECT document_id, md5(trim(regexp_replace(lower(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g')), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS h FROM corpus""")
def comparable_text(spark, sf_dir):
    """X15, X16."""
    return corpus(spark, sf_dir).select("document_id", F.md5(text.comparable(F.col("content"))).alias("h"))


@query(r"""SELECT document_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM corpus""")
def chunkable_text(spark, sf_dir):
    """X17."""
    return corpus(spark, sf_dir).select("document_id", F.md5(text.chunkable(F.col("content"))).alias("h"))


@query(r"""SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'),
  lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'der', 'die', 'das', 'und', 'le', 'la', 'les', 'de', 'el', 'los')) AS w FROM benchmark)""")
def search_terms(spark, sf_dir):
    """X21, X22, D11."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS v FROM benchmark) SELECT item_id, v[1] || ' ' || v[2] || ' ' || v[3] || ' ' || v[4] AS plain, '+' || v[1] || ' +"' || v[2] || ' ' || v[3] || '" -' || v[4] AS unwrapped FROM w WHERE len(v) >= 4""")
def boolean_syntax(spark, sf_dir):
    """Generated queries with brackets around words and phrases, made of the words of each benchmark text."""
    v = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    w = lambda i: F.get("v", F.lit(i))
    q = table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).where(F.size("v") >= 4)
    asked = F.concat(F.lit("+("), w(0), F.lit(") +(„"), w(1), F.lit(" "), w(2), F.lit("“) -"), w(3))
    q = q.select("item_id", text.straight_quotes(asked).alias("q"))
    return q.select("item_id", text.plain_query(F.col("q")).alias("plain"), text.unwrap_groups(F.col("q")).alias("unwrapped"))


@query("""SELECT c_custkey, '+' || regexp_replace(c_name, '[^0-9]', '', 'g') AS phone, lower(c_name) || '@example.com' AS email FROM customer""")
def contact_keys(spark, sf_dir):
    """X2."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.phone_key(F.concat(F.lit("+"), "c_name")).alias("phone"), text.email_key(F.concat(F.lit(" "), "c_name", F.lit("@Example.com "))).alias("email"))


@query("""SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') || ' ug' AS key, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS core FROM supplier""")
def organisation_keys(spark, sf_dir):
    """X3, X6."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" Unternehmergesellschaft (haftungsbeschränkt)")).alias("name"))
    return s.select("s_suppkey", text.organisation_key(F.col("name")).alias("key"), text.organisation_core(F.col("name")).alias("core"))


@query("""SELECT c_custkey, unnest(['Ada ' || c_name, c_name || ' Ada', c_name || ', Ada', 'A. ' || c_name, c_name]) AS value, unnest(['full', 'reversed', 'comma', 'initial', 'family']) AS kind, CAST(unnest([1.0, 0.95, 0.95, 0.7, 0.4]) AS DOUBLE) AS weight FROM customer""")
def person_aliases(spark, sf_dir):
    """Generated names."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(text.person_aliases(F.lit("Ada"), F.col("c_name"))).alias("a")).select("c_custkey", "a.value", "a.kind", "a.weight")


@query(r"""SELECT document_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) - 1 - 4 * ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) // 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT document_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(document_id || ':0')) AS h FROM corpus)""")
def point_ids(spark, sf_dir):
    """Deterministic UUIDs in native expressions."""
    return corpus(spark, sf_dir).select("document_id", text.uuid5(_NAMESPACE, F.concat("document_id", F.lit(":0"))).alias("point_id"))


@query("SELECT document_id, 'doc:' || substr(sha256(document_id || chr(0) || content_hash), 1, 24) AS id FROM corpus")
def stable_ids(spark, sf_dir):
    """X7, X10, X12."""
    return corpus(spark, sf_dir).select("document_id", text.stable_id("doc:", F.col("document_id"), F.col("content_hash")).alias("id"))


@query()
def folded_names(spark, sf_dir):
    """X1, X40."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.folded_name(F.concat("c_name", F.lit(" ßﬁ"))).alias("name"), text.predicate_name(F.concat(F.lit("é mit "), "c_name")).alias("predicate"))


@query()
def document_chunks(spark, sf_dir):
    """The live chunker over every document."""
    return corpus(spark, sf_dir).select("document_id", F.explode(chunks.search_chunks("content")).alias("c")).select("document_id", "c.chunk_no", "c.start", F.length("c.text").alias("size"))


@query()
def graph_chunks(spark, sf_dir):
    """G2, G3."""
    return corpus(spark, sf_dir).select("document_id", F.explode(chunks.graph_chunks("content")).alias("c")).select("document_id", "c.chunk_no", "c.start", F.length("c.text").alias("size"))


@query()
def source_dates(spark, sf_dir):
    """X26, X27."""
    return corpus(spark, sf_dir).select("document_id", dates.source_date("path", "content").alias("d")).select("document_id", "d.*")


@query()
def page_fields(spark, sf_dir):
    """Title, description, publisher and visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", pages.page_fields("html").alias("p")).select("page_id", "p.title", "p.published", F.length("p.text").alias("n_chars"))


@query(r"""SELECT lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '#.*$', '') AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1""")
def url_dedupe(spark, sf_dir):
    """D13."""
    return table(spark, sf_dir, "pages").groupBy(pages.url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query()
def passages(spark, sf_dir):
    """The two best passages of each page for its own title."""
    return pages.best_passages(table(spark, sf_dir, "pages"), 2)


@query()
def mail_messages(spark, sf_dir):
    """Raw messages made of conversation turns, parsed."""
    return mail.parsed(mail.raw_messages(table(spark, sf_dir, "conversations")))


@query("""WITH m AS (SELECT 'mail:' || conv_id || '.' || turn AS message_key, CASE WHEN turn > 0 THEN 'mail:' || conv_id || '.' || (turn - 1) END AS parent FROM conversations)
SELECT m.message_key, m.parent, m.parent IS NOT NULL AND p.message_key IS NULL AS placeholder FROM (SELECT DISTINCT * FROM m) m LEFT JOIN (SELECT DISTINCT message_key FROM m) p ON m.parent = p.message_key""")
def reply_threads(spark, sf_dir):
    """Child to parent, with placeholders for parents that are missing."""
    return mail.threads(mail.parsed(mail.raw_messages(table(spark, sf_dir, "conversations")))).select("message_key", "parent", "placeholder")


@query("""SELECT c_custkey, c_name AS full_name, 'c' || c_custkey || '@example.com' AS emails, '+49' || c_custkey AS phones FROM customer""")
def vcards(spark, sf_dir):
    """S15, S16."""
    return mail.cards(table(spark, sf_dir, "customer")).select("c_custkey", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


@query("""SELECT conv_id, {'schema': 'mail-1', 'ids': 1} IS NOT NULL AS known, '<' || conv_id || '.' || turn || '@example.org>' AS message_id, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS n_references, CASE WHEN turn = 0 THEN 'thread' ELSE 'reply' END AS representation FROM conversations""")
def sidecar_metadata(spark, sf_dir):
    """JSON sidecars with lists or single values."""
    return mail.sidecars(table(spark, sf_dir, "conversations"))
