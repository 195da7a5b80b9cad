"""Entity names in texts: exact and fuzzy matches, chosen longest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.ratios import Strings, candidates, ratios
from lodestar.operators.lexical import if_small, words


def grams(text: Column, most: int) -> Column:
    """All runs of up to `most` words as structs (pos, size, gram)."""
    w = words(text)
    sizes = F.sequence(F.lit(1), F.lit(most))
    at = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(at(n), lambda p: F.struct(p.alias("pos"), n.alias("size"), F.array_join(F.slice(w, p, n), " ").alias("gram")))))


def exact_matches(texts: DataFrame, forms: DataFrame, most: int = 3) -> DataFrame:
    """(text_id, pos, size, entity_id): forms of up to `most` words that stand in a text, by an equi-join on word runs."""
    runs = texts.select("text_id", words(F.col("text")).alias("w")).select("text_id", F.posexplode("w").alias("pos", "word"), "w")
    sizes = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("size")
    spans = runs.select("text_id", "pos", "w", sizes).where(F.col("pos") + F.col("size") <= F.size("w")).select("text_id", "pos", "size", F.array_join(F.slice("w", F.col("pos") + 1, F.col("size")), " ").alias("gram"))
    return spans.join(forms.select(F.col("normalized").alias("gram"), "entity_id"), "gram").select("text_id", "pos", "size", "entity_id", "gram")


CHOSEN = "text_id long, pos int, size int, entity_id string, gram string"


def longest_first(matches: DataFrame) -> DataFrame:
    """Matches that don't overlap a longer one chosen before; ties go to the earlier, then the smaller entity."""

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        kept = []
        for r in found.sort_values(["size", "pos", "entity_id"], ascending=[False, True, True]).itertuples(index=False):
            places = set(range(r.pos, r.pos + r.size))
            if not places & taken:
                taken |= places
                kept.append((r.text_id, r.pos, r.size, r.entity_id, r.gram))
        return pd.DataFrame(kept, columns=["text_id", "pos", "size", "entity_id", "gram"])

    return matches.groupBy("text_id").applyInPandas(fold, CHOSEN)


FORMS, PIECE = 512, 8192
FOUND = "text_id long, pos int, size int, gram string, entity_id string, form string, ratio double"


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(block): the rows as Arrow tables of `most` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part, sink = pa.Table.from_batches([batch.slice(start, most)]).combine_chunks(), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    return rows.mapInArrow(run, "block binary")


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                spans, forms = (pa.ipc.open_stream(batch.column(c)[r].as_buffer()).read_all() for c in ("block", "forms"))
                grams = spans["gram"].combine_chunks().dictionary_encode()
                a, b = Strings(grams.dictionary.to_pylist()), Strings(forms["form"].to_pylist())
                words_a, words_b = (np.fromiter((v.count(" ") for v in x.values), np.int64, len(x.values)) for x in (a, b))
                code = grams.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                first = np.searchsorted(code[order], np.arange(len(a.values) + 1))
                for i, j in candidates(a, b, least):
                    close = np.abs(words_a[i] - words_b[j]) <= 1
                    i, j = i[close], j[close]
                    ratio = ratios(a, b, i, j)
                    near = ratio >= least - 1e-3
                    i, j, ratio = i[near], j[near], ratio[near]
                    repeats = first[i + 1] - first[i]
                    row = order[np.repeat(first[i] - np.cumsum(repeats) + repeats, repeats) + np.arange(repeats.sum())]
                    j, ratio = np.repeat(j, repeats), np.repeat(ratio, repeats)
                    for k in range(0, len(row), PIECE):
                        found = spans.take(pa.array(row[k : k + PIECE])).combine_chunks()
                        entity = forms.take(pa.array(j[k : k + PIECE])).combine_chunks()
                        columns = [found.select(["text_id", "pos", "size", "gram"]), entity.select(["entity_id", "form"])]
                        arrays = [c for t in columns for x in t.columns for c in [x.combine_chunks()]]
                        yield pa.RecordBatch.from_arrays([*arrays, pa.array(ratio[k : k + PIECE])], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def fuzzy_matches(spans: DataFrame, forms: DataFrame, least: float) -> DataFrame:
    """Spans and forms whose numbers of words differ by one at most, by Indel ratio.

    Blocks of spans meet blocks of forms where the spans are read, so spans aren't shuffled. Different spans of a block are
    compared once. Signatures of the characters bound the distance before the exact ratio.
    """
    a = spans.select(F.col("text_id").cast("long").alias("text_id"), F.col("pos").cast("int").alias("pos"), F.col("size").cast("int").alias("size"), "gram").where("gram is not null")
    b = forms.select("entity_id", F.col("normalized").alias("form")).where("form is not null")
    blocks = _packed(b, FORMS).withColumnRenamed("block", "forms")
    met = _packed(a, PIECE).crossJoin(if_small(blocks, b)).mapInArrow(_alike(least), FOUND)
    return met.where("gram <> form").withColumn("ratio", F.round("ratio", 4)).where(F.col("ratio") >= least)


def best_candidates(found: DataFrame) -> DataFrame:
    """Each entity's best score with the reasons of all its candidates."""
    return found.groupBy("text_id", "entity_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def kept_windows(windows: Column, most: float = 0.55) -> Column:
    """Windows (start, end) in order, without those that one kept before covers by more than `most`."""
    shared = lambda w, k: F.greatest(F.least(w["end"], k["end"]) - F.greatest(w["start"], k["start"]), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(windows, empty, lambda kept, w: F.when(F.exists(kept, lambda k: shared(w, k) >= most * F.least(w["end"] - w["start"], k["end"] - k["start"])), kept).otherwise(F.concat(kept, F.array(w))))
