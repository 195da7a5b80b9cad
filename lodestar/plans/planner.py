"""Plans of questions: entities, phrases, arms and budgets (expressions on columns, and keyed tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.lexical import if_small

# Words that don't narrow a question about one entity.
BROAD_WORDS = (
    "alle alles dokument dokumente dokumenten finde find gibt informationen information info infos mir nach suche such uber über unterlagen was weisst weißt "
    "wissen zu zeige zeig wer ist es den die der eine einen zum zur von intern interne internen netz web internet online und im"
).split()
# Words that ask for a relation, and states in which a detected entity can be used.
RELATION_WORDS = "verbindung zusammenhang beziehung verhältnis verhaeltnis relation".split()
USABLE = ("resolved", "ambiguous", "fuzzy_candidate")
# Titles before a person's name.
TITLES = r"herrn?|frau|fraeulein|fräulein|prof(?:essor)?\.?|dr\.?|dipl\.?[- ]?ing\.?|rechtsanwalt(?:in)?|notar(?:in)?"
# The most that a fuzzy candidate's form weighs, and the share of its score that counts.
FUZZY_MOST, FUZZY_SHARE = 0.76, 0.82
WORD = r"[\p{L}\p{N}_-]+"
DATED = r"\b(?:19|20)[0-9]{2}\b|\b[0-9]{1,2}[./-][0-9]{1,2}(?:[./-][0-9]{2,4})?\b"


def broad_entity(question: Column, mention: Column, resolved: Column) -> Column:
    """Whether a question about exactly one resolved entity says nothing that narrows it."""
    at = F.instr(F.lower(question), F.lower(mention))
    rest = F.when((at > 0) & (mention != ""), F.concat(F.substr(question, F.lit(1), at - 1), F.lit(" "), F.substr(question, at + F.length(mention)))).otherwise(question)
    words = F.filter(F.regexp_extract_all(F.lower(rest), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)
    return (resolved == 1) & ~rest.rlike(DATED) & (F.size(F.array_except(words, F.array(*map(F.lit, BROAD_WORDS)))) == 0)


def usable(statuses: Column) -> Column:
    """How many of the detected entities can be used."""
    return F.size(F.filter(statuses, lambda s: s.isin(*USABLE)))


def relation_question(question: Column, statuses: Column) -> Column:
    """Two usable entities at least and a word that asks for their relation."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return (usable(statuses) >= 2) & F.arrays_overlap(words, F.array(*map(F.lit, RELATION_WORDS)))


def person_name(name: Column) -> Column:
    """The name without titles before it and without marks at its ends, taken off until nothing changes."""
    return F.regexp_replace(F.regexp_replace(name, rf"(?i)^[ \t\r\n,;:]*(?:(?:{TITLES})\s[ \t\r\n,;:]*)*", ""), r"[ \t\r\n,;:]+$", "")


def arms(required: Column, optional: Column, requested: Column, available: Column) -> Column:
    """Required and available arms, and the optional ones that were requested; without a request, all optional ones."""
    some = F.when(requested.isNull(), optional).otherwise(F.array_intersect(optional, requested))
    return F.array_sort(F.array_intersect(F.array_union(required, some), available))


def longest_terms(terms: Column, most: int = 12) -> Column:
    """The longest different terms, the earlier of equal ones first."""
    unique = F.array_distinct(terms)
    ranked = F.array_sort(F.transform(unique, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["t"])


def spec_frame(intent: Column, entities: Column, constraints: Column, concepts: Column) -> Column:
    """The query frame of a specification: entities are numbered q1, q2, ... by their place, blank ones left out."""
    numbered = F.transform(entities, lambda e, i: F.struct(F.concat(F.lit("q"), (i + 1).cast("string")).alias("id"), e.alias("text"), F.lit("").alias("role")))
    held = F.filter(numbered, lambda e: F.trim(e["text"]) != "")
    return F.struct(F.substring(intent, 1, 500).alias("intent"), held.alias("entities"), constraints.alias("constraints"), concepts.alias("concepts"))


def entity_phrases(detected: DataFrame, forms: DataFrame, strong: float) -> DataFrame:
    """(question_id, entity_id, normalized, value, weight): the forms of resolved entities, each once, and those of the best strong fuzzy candidate.

    detected: question_id, entity_id, status, score; forms: entity_id, normalized, value, weight. A fuzzy form weighs less than its score.
    """
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "entity_id")
    fuzzy = detected.where((F.col("status") == "fuzzy_candidate") & (F.col("score") >= strong)).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    # An entity's forms are reduced before they meet questions: its best form, and for fuzzy ones, which all weigh alike, the last value.
    held = forms.groupBy("entity_id", "normalized").agg(F.max(F.struct(F.round("weight", 4).alias("weight"), "value")).alias("best"), F.max("value").alias("last"))
    used = detected.where("status = 'resolved'").unionByName(fuzzy).join(if_small(held), "entity_id")
    capped = F.round(F.least(F.lit(FUZZY_MOST), F.col("score") * FUZZY_SHARE), 4)
    one = F.when(F.col("status") == "resolved", F.col("best")).otherwise(F.struct(capped.alias("weight"), F.col("last").alias("value")))
    once = used.select("question_id", "entity_id", "normalized", one.alias("one")).groupBy("question_id", "entity_id", "normalized")
    return once.agg(F.max("one").alias("b")).select("question_id", "entity_id", "normalized", "b.value", "b.weight")


def reranked(hits: DataFrame, scores: DataFrame, least: float, most: int) -> DataFrame:
    """Hits with a reranker's score (query_id, document_id, rerank) at or above the least one, best first, then by fused score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("score"), "document_id")
    scored = hits.join(scores, ["query_id", "document_id"]).where(F.col("rerank") >= least)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def within_budget(results: DataFrame, most_results: int, most_chars: int) -> DataFrame:
    """Per query the number of results, their characters and what the budget says about them."""
    r = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.sum(F.length("text")).alias("chars"))
    return r.withColumn("verdict", F.when(F.col("results") > most_results, "max_results").when(F.col("chars") > most_chars, "max_evidence_chars").otherwise("ok"))


def kept_phrases(original: Column, rewritten: Column) -> Column:
    """The rewritten query with the quoted phrases of two words or more that the user wrote, as they wrote them.

    Words that the user wrote only inside such a phrase go, as do the rewriter's own copies of the phrase.
    """
    token = r'[+-]?"[^"]+"|[^\s"]+'
    bare = lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, r'^[+-]|"', ""), r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", ""))
    all_ = lambda q: F.regexp_extract_all(q, F.lit(token), F.lit(0))
    quoted = F.filter(all_(original), lambda t: t.rlike(r'^[+-]?"\s*\S+\s+\S'))
    phrases = F.transform(quoted, bare)
    outside = F.transform(F.filter(all_(original), lambda t: ~F.array_contains(quoted, t)), bare)
    inside = F.array_except(F.flatten(F.transform(phrases, lambda p: F.split(p, r"\s+"))), outside)
    kept = F.filter(all_(rewritten), lambda t: F.when(F.contains(t, F.lit('"')), ~F.array_contains(phrases, bare(t))).otherwise(~F.array_contains(inside, bare(t))))
    return F.when(F.size(quoted) == 0, rewritten).otherwise(F.array_join(F.concat(kept, quoted), " "))


def mailboxes(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """Selectable mailboxes at or below a root, each once; a root that nothing shows is kept.

    listed: name, selectable; roots: root. Names are cut at every slash, so the join is by equal prefixes.
    """
    parts = F.split("name", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = listed.select("name", "selectable", F.explode(prefixes).alias("root")).join(roots.distinct(), "root")
    unseen = roots.distinct().join(under.select("root"), "root", "left_anti").select(F.col("root").alias("name"))
    return under.where("selectable").select("name").distinct().unionByName(unseen).distinct()
