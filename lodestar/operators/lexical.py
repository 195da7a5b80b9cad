"""Lexical retrieval over batches of queries.

Analyzer: lower-cased runs of letters and digits, no stemming. Scores are BM25 (k1 1.2, b 0.75).
Lengths, document frequencies and term frequencies all come from one shuffle by document, which carries texts, not their words;
a query's score needs no other. Texts are split twice after it, for counts and for scores. Query terms go to the texts while a
batch has at most SMALL of them; a larger batch is joined by shuffles. The shuffle has as many partitions as keep the rows that
a task aggregates under HITS, however many documents and queries there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
SMALL = 500_000
HITS, MATCHED = 1 << 20, 200  # most rows of a task; terms that any document is taken to share with a batch


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term) with each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def if_small(df: DataFrame, source: DataFrame | None = None, most: int = SMALL) -> DataFrame:
    """The table, marked for broadcast if it (or the source that bounds it) has no more rows than that."""
    return F.broadcast(df) if (source or df).limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Input of few files is dealt to all cores before costly expressions; input of many files stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def parts(docs: DataFrame, terms: DataFrame, *group: str, times: int = 1) -> int:
    """Partitions by document in which each document may give rise to a row for each group of the terms, some times over.

    A text of n characters holds (n + 1) / 2 words at most, so a document's rows are bounded before any text is split.
    """
    groups, known = terms.select(*group).distinct().count(), terms.select("term").distinct().count()
    if known <= max(groups, MATCHED):
        rows = docs.count() * max(groups, known)
    else:
        held = F.floor((F.coalesce(F.length(F.lower("content")), F.lit(0)) + 1) / 2)
        rows = docs.agg(F.sum(F.greatest(F.lit(groups), F.least(F.lit(known), F.greatest(F.lit(MATCHED), held))))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows * times // HITS))


def matches(docs: DataFrame, terms: DataFrame, n: int, *by: str) -> DataFrame:
    """(document_id, by, dl, term, tf) for the terms of the batch, and for each document the empty term, in n partitions by document.

    Texts are dealt to the partitions and split there: a task that deals out holds no more than its share of the texts, which
    are a tenth of the size of rows of their words.
    """
    asked = if_small(terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct())
    split = docs.select("document_id", *by, "content").repartition(n, "document_id").select("document_id", *by, words(F.col("content")).alias("w"))
    tokens = split.select("document_id", *by, F.size("w").alias("dl"), F.explode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    return tokens.join(asked, "term", "left_semi").groupBy("document_id", *by, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_parts(docs: DataFrame, terms: DataFrame, n: int | None = None, *by: str) -> DataFrame:
    """(query_id, document_id, by, term, part): what each term of a query adds to a document's score.

    by: columns of documents that stand for several fields, each with statistics of its own; n: partitions by document.
    """
    found = matches(docs, terms, n or parts(docs, terms, "query_id"), *by)
    # no more rows than the batch has terms in each field; both uses below read all columns, so that one exchange serves both
    counts = found.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words"), F.count("dl").alias("texts"))
    of = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    stats = F.broadcast(counts.groupBy(*by).agg(of("df").alias("n_docs"), (of("words") / of("texts")).alias("avg_dl")))  # one row for each field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    known = terms.join(counts.where("words is not null and texts > 0").drop("words", "texts"), "term")
    weighted = known.join(stats, [*by]) if by else known.crossJoin(stats)
    return found.join(if_small(weighted, terms), [*by, "term"]).select("query_id", "document_id", *by, "term", part.alias("part"))


def bm25(docs: DataFrame, terms: DataFrame, n: int | None = None, *by: str) -> DataFrame:
    """(query_id, document_id, by, score, matched) for every document that holds a term of the query."""
    return bm25_parts(docs, terms, n, *by).groupBy("query_id", "document_id", *by).agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def top_k(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The best k of each group with their rank; ties go to the smaller document_id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "document_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def enough(hits: DataFrame, terms: DataFrame, share: float) -> DataFrame:
    """Hits that match at least floor(share * terms) terms of their query, and one."""
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    return hits.join(sizes, "query_id").where(F.col("matched") >= F.greatest(F.floor(F.col("asked") * share), F.lit(1))).drop("asked")


def positions(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(document_id, pos, term) of some terms."""
    return docs.select("document_id", F.posexplode(words(F.col("content"))).alias("pos", "term")).where(F.col("term").isin(*terms))


def phrase(content: Column, terms: list[str], prefix: bool = False) -> Column:
    """Whether the terms stand side by side; with prefix, the last may be the start of a word."""
    if not terms:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(words(content), " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(terms)}" + ("" if prefix else " ")))


def sloppy(docs: DataFrame, first: str, second: str, slop: int) -> DataFrame:
    """Documents where `second` follows `first` with at most `slop` words between."""
    found = positions(docs, [first, second])
    follows = Window.partitionBy("document_id").orderBy("pos").rangeBetween(1, slop + 1)
    hit = F.max(F.when(F.col("term") == second, 1)).over(follows)
    return found.withColumn("hit", hit).where((F.col("term") == first) & (F.col("hit") == 1)).groupBy("document_id").agg(F.count(F.lit(1)).alias("occurrences"))


def boolean(docs: DataFrame, must: list[str], should: list[str], must_not: list[str]) -> DataFrame:
    """Documents with all of must, none of must_not, and the number of should terms; one of should suffices where nothing is mandatory."""
    w = words(F.col("content"))
    held = lambda ts: F.size(F.array_intersect(w, F.array(*map(F.lit, ts)).cast("array<string>")))
    out = docs.select("document_id", held(must).alias("m"), held(should).alias("s"), held(must_not).alias("x"))
    keep = (F.col("m") == len(must)) & (F.col("x") == 0)
    if should and not must:
        keep = keep & (F.col("s") > 0)
    return out.where(keep).select("document_id", F.col("s").alias("optional"))


def query_tokens(text: Column) -> Column:
    """Tokens of a query as structs: sign (+, - or empty), phrase or word, and its value."""
    raw = F.regexp_extract_all(F.translate(text, "“”„«»", '"' * 5), F.lit(r'[+-]?"[^"]+"|[+-]?[^\s"]+'), F.lit(0))

    def one(t: Column) -> Column:
        sign = F.when(F.substring(t, 1, 1).isin("+", "-"), F.substring(t, 1, 1)).otherwise("")
        rest = F.regexp_replace(t, "^[+-]", "")
        quoted = rest.startswith('"')
        return F.struct(sign.alias("sign"), F.when(quoted, "phrase").otherwise("word").alias("kind"), F.regexp_replace(rest, '"', "").alias("value"))

    return F.filter(F.transform(raw, one), lambda t: F.length(F.trim(t["value"])) > 0)


def snippet(content: Column, terms: Column, reach: int = 120) -> Column:
    """The stretch around the first occurrence of any term, or the beginning."""
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(content), t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - reach // 2, F.lit(1))
    return F.substr(content, start, F.lit(reach))


def best_field(docs: DataFrame, terms: DataFrame, boost: float = 1.0) -> DataFrame:
    """(query_id, document_id, score): the better of twice the score over name and text together and the score over the text, times a boost."""
    field = lambda factor, content: F.struct(F.lit(factor).alias("factor"), content.alias("content"))
    both = F.array(field(2.0, F.concat_ws(" ", "path", "content")), field(1.0, F.col("content")))
    texts = docs.select("document_id", F.explode(both).alias("field")).select("document_id", "field.factor", "field.content")
    longer = docs.select(F.concat_ws(" ", "path", "content").alias("content"))
    each = bm25(texts, terms, parts(longer, terms, "query_id", times=2), "factor")
    return each.groupBy("query_id", "document_id").agg((F.max(F.col("score") * F.col("factor")) * boost).alias("score"))


def entity_groups(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """(query_id, document_id, score): of an entity's forms of two words the best that stands in a document.

    forms: query_id, first, second, slop, boost. Forms meet documents by their first word; up to `slop` words may stand between.
    """
    tokens = spread(docs.select("document_id", "content")).select("document_id", words(F.col("content")).alias("w")).select("document_id", F.posexplode("w").alias("pos", "first"), "w")
    runs = tokens.select("document_id", "first", F.try_element_at("w", F.col("pos") + 2).alias("next"), F.try_element_at("w", F.col("pos") + 3).alias("after")).distinct()
    hit = (F.col("next") == F.col("second")) | ((F.col("slop") >= 1) & (F.col("after") == F.col("second")))
    return runs.join(if_small(forms), "first").where(hit).groupBy("query_id", "document_id").agg(F.max("boost").alias("score"))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, most: int = 50, boost: float = 0.35) -> DataFrame:
    """(term, expansion, distance, boost): words with the same first two letters within the distance that a term's length allows.

    Up to two letters must be equal, up to five may differ in one place, longer ones in two; the nearest `most` count.
    """
    key = lambda c: F.substring(c, 1, 2).alias("head")
    t = terms.select("term").distinct().select("term", key("term"), F.when(F.length("term") < 3, 0).when(F.length("term") <= 5, 1).otherwise(2).alias("edits"))
    v = vocabulary.select(F.col("term").alias("expansion")).distinct().select("expansion", key("expansion"))
    near = t.join(v, "head").where((F.abs(F.length("term") - F.length("expansion")) <= F.col("edits")) & (F.col("term") != F.col("expansion")))
    found = near.withColumn("distance", F.levenshtein("term", "expansion", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
    order = Window.partitionBy("term").orderBy("distance", "expansion")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("term", "expansion", "distance", F.lit(boost).alias("boost"))
