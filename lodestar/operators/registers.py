"""Registers of contacts, forms and runs as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Scores of how a mention meets a form, and what each shared context adds, up to a limit.
EXACT_NAME, EXACT_ALIAS, PREFIX_NAME, PREFIX_ALIAS = 0.98, 0.93, 0.82, 0.78
CONTEXT, CONTEXT_MOST = 0.03, 0.09
SHORTEST_PREFIX = 3


def prefix_matches(mentions: DataFrame, forms: DataFrame) -> DataFrame:
    """(mention, entity_id, named, equal): forms that are a mention, begin it or begin with it, by equal prefixes.

    mentions: mention; forms: entity_id, normalized, named. A prefix has SHORTEST_PREFIX characters at least.
    """
    cut = lambda c: F.explode(F.transform(F.sequence(F.lit(SHORTEST_PREFIX), F.length(c)), lambda n: F.substr(F.col(c), F.lit(1), n)))
    m = mentions.select("mention").distinct().where(F.length("mention") >= SHORTEST_PREFIX)
    f = forms.where(F.length("normalized") >= SHORTEST_PREFIX).distinct()
    longer = m.join(f.withColumn("mention", cut("normalized")), "mention")
    shorter = m.withColumn("normalized", cut("mention")).where("normalized <> mention").join(f, "normalized")
    return longer.unionByName(shorter).select("mention", "entity_id", "named", (F.col("mention") == F.col("normalized")).alias("equal"))


def match_scores(matches: DataFrame, contexts: DataFrame) -> DataFrame:
    """(mention, entity_id, score): the best way a mention meets an entity, and what shared contexts (entity_id, shared) add."""
    way = F.when(F.col("equal"), F.when(F.col("named"), EXACT_NAME).otherwise(EXACT_ALIAS)).otherwise(F.when(F.col("named"), PREFIX_NAME).otherwise(PREFIX_ALIAS))
    best = matches.groupBy("mention", "entity_id").agg(F.max(way).alias("score"))
    extra = F.least(F.coalesce("shared", F.lit(0)) * CONTEXT, F.lit(CONTEXT_MOST))
    return best.join(contexts, "entity_id", "left").select("mention", "entity_id", F.round(F.col("score") + extra, 4).alias("score"))


def best_candidates(scored: DataFrame, most: int) -> DataFrame:
    """The best entities of each mention; ties go to the smaller id."""
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def logged(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The log with the rows whose key it lacks; each key once, so that a repeated insert changes nothing."""
    return log.unionByName(rows.dropDuplicates([key]).join(log.select(key), key, "left_anti"))


def reassigned(contacts: DataFrame, history: DataFrame, run: Column) -> DataFrame:
    """Contacts after an import run is rolled back: each goes to the entity it had before, or away if it had none.

    contacts: contact_id, entity_id, run_id; history: contact_id, entity_id, run_id of earlier states.
    """
    bad = contacts.where(run)
    before = history.join(bad.select("contact_id"), "contact_id", "left_semi").groupBy("contact_id").agg(F.max(F.struct("run_id", "entity_id")).alias("h"))
    back = before.select("contact_id", "h.entity_id", "h.run_id")
    return contacts.where(~run).select("contact_id", "entity_id", "run_id").unionByName(back)


def repaired_origins(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_id, origin, was): documents whose stated origin differs from the registry's, or else from that of their path."""
    j = documents.join(registry.withColumnRenamed("origin", "registered"), "document_id", "left")
    right = F.coalesce("registered", "derived")
    return j.where(~right.eqNullSafe(F.col("stated"))).select("document_id", right.alias("origin"), F.col("stated").alias("was"))


def public_address(value: Column) -> Column:
    """Whether dotted numbers are a public IPv4 address; the special ranges are those of the address registry."""
    p = F.split(value, r"\.")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    a, b, c = n(0), n(1), n(2)
    shaped = value.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") & F.forall(p, lambda x: x.try_cast("int") <= 255)
    # Private, shared, loopback, link-local, documentation, benchmark, multicast and reserved ranges.
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.between(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(shaped & ~special, F.lit(False))


def observation_reason(kind: Column, form: Column, evidence: Column, text: Column, kinds: tuple[str, ...]) -> Column:
    """Why an observed entity doesn't count, or 'ok': its kind, then its evidence in the text, then its form in the evidence."""
    fold = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "kind").when(F.trim(F.coalesce(form, F.lit(""))) == "", "empty")
        .when(~F.coalesce(F.contains(fold(text), fold(evidence)), F.lit(False)), "evidence").when(~F.contains(fold(evidence), fold(form)), "form").otherwise("ok")
    )
