"""Catalogue queries on small tables of their own."""

import random
import tracemalloc
from difflib import SequenceMatcher
from math import log

import numpy as np
import pyarrow as pa

from lodestar import catalogue
from lodestar.functions import ratios, text
from lodestar.operators import dedup, lexical, spans, vector
from lodestar.plans import planner

QUERIES = catalogue.queries()


def test_identities_of_different_balances(spark, tmp_path):
    names = [("Ada Lovelace", 1499.0), ("ada  lovelace", 1501.0), ("Ada King Lovelace", 9000.0), ("Ada Lovelade", 1490.0), ("Ada Lovelade", None), ("Bob Stone", 1499.0)]
    rows = [(i, n, 1, b, "HOME") for i, (n, b) in enumerate(names)] + [(9, "Ada Lovelace", 2, 1499.0, "HOME")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.id_a, r.id_b): r.score for r in QUERIES["identity_suggestions"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 0.55, (0, 2): 0.52, (1, 2): 0.52, (0, 3): 0.62, (3, 4): 0.55}


def test_variants_by_whole_texts(spark, tmp_path):
    part = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    common, schema = "needle " + part("w", 600), "doc_id long, text string, lang string, source string, n_chars long"
    texts = [f"{common} {part('a', 300)}", f"{common} {part('b', 300)}", f"{common} {part('a', 299)}", "other words"]
    spark.createDataFrame([(10 * i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.document_id: r.variants for r in QUERIES["arm_dedup"](spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == [0, 1] and "files:10" in got


def test_matching_is_that_of_the_library():
    rng = random.Random(3)
    for _ in range(500):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) if rng.random() < 0.5 else a[5:20] + a[:30] + "c" + a[31:]
        assert dedup.matching(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_fuzzy_matches_at_the_beginning_and_with_other_word_counts(spark):
    grams = ["dohn smithson", "john smith son", "johnsmithson", "john smithson", "jane doe"]
    runs = spark.createDataFrame([(1, i, 2, g) for i, g in enumerate(grams)], "text_id long, pos int, size int, gram string")
    forms = spark.createDataFrame([("E1", "john smithson")], "entity_id string, normalized string")
    got = {r.gram: r.ratio for r in spans.fuzzy_matches(runs, forms, 85.0).collect()}
    assert got == {"dohn smithson": 92.3077, "john smith son": 96.2963, "johnsmithson": 96.0}


def test_ratios_of_many_pairs_are_those_of_single_ones():
    rng = random.Random(5)
    draw = lambda n: ["".join(rng.choice("abcdé ß😀x"[: rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 13, 63, 64, 65, 300]) if rng.random() < 0.3 else rng.randint(0, 20))) for _ in range(n)]
    x, y = draw(120), draw(100)
    y[:30] = x[:30]
    a, b = ratios.Strings(x), ratios.Strings(y)
    i, j = (g.ravel() for g in np.meshgrid(np.arange(120), np.arange(100), indexing="ij"))
    want = [text.indel(x[p], y[q]) for p, q in zip(i, j, strict=True)]
    assert ratios.ratios(a, b, i, j).tolist() == want
    found = {(p, q) for k, m in ratios.candidates(a, b, 85.0) for p, q in zip(k.tolist(), m.tolist(), strict=True)}
    assert {(p, q) for p, q, v in zip(i.tolist(), j.tolist(), want, strict=True) if v >= 85} <= found


def test_fuzzy_matches_without_a_shuffle_of_spans(spark):
    spans_ = spark.range(20_000).selectExpr("id % 7 text_id", "cast(id as int) pos", "2 size", "concat('john ', case when id % 4 = 0 then 'smitson' else cast(id as string) end) gram")
    forms = spark.createDataFrame([(f"E{i}", "john smithson" if i == 3 else f"jane {i} doe") for i in range(1500)], "entity_id string, normalized string")
    got = spans.fuzzy_matches(spans_, forms, 85.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    rows = got.collect()
    assert len(rows) == 5000 and {(r.gram, r.entity_id, r.ratio) for r in rows} == {("john smitson", "E3", 96.0)} and {r.pos for r in rows} == set(range(0, 20_000, 4))


def test_entity_phrases_reduce_forms_before_questions_meet_them(spark):
    rng = random.Random(2)
    forms = [(f"N{rng.randint(0, 3)}", rng.choice("ab"), rng.choice([None, "x", "y", "z"]), rng.choice([None, 0.61234, 0.5, 0.9])) for _ in range(60)]
    detected = [(rng.randint(0, 30), f"N{rng.randint(0, 4)}", rng.choice(["resolved", "fuzzy_candidate", "unknown"]), rng.choice([0.8, 0.9, 0.95])) for _ in range(90)]
    got = planner.entity_phrases(spark.createDataFrame(detected, "question_id long, entity_id string, status string, score double"), spark.createDataFrame(forms, "entity_id string, normalized string, value string, weight double"), 0.88)
    fuzzy, want = {}, {}
    for q, e, s, x in detected:
        if s == "fuzzy_candidate" and x >= 0.88:
            fuzzy[q] = min(fuzzy.get(q, (1, "")), (-x, e))
    low = lambda v: (v is not None, v or 0)
    for q, e, s, x in [d for d in detected if d[2] == "resolved"] + [(q, e, "fuzzy", -x) for q, (x, e) in fuzzy.items()]:
        for entity, n, value, weight in forms:
            if entity == e:
                w = (None if weight is None else round(weight, 4)) if s == "resolved" else round(min(0.76, x * 0.82), 4)
                want[q, e, n] = max(want.get((q, e, n), (None, None)), (w, value), key=lambda p: (low(p[0]), (p[1] is not None, p[1] or "")))
    assert {(r.question_id, r.entity_id, r.normalized): (r.weight, r.value) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_facts_of_one_number_and_alike_facts_all_count(spark, tmp_path):
    from datetime import datetime

    day = datetime(2000, 1, 1)
    rows = [(1, 1, 7, 4, day), (1, 1, 7, 5, day), (1, 1, 7, 4, day), (1, 2, 7, 6, day), (None, 1, 7, None, None), (2, 1, 8, 4, datetime(2001, 1, 1)), (2, 3, 8, 4, day)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.entity_id: (r.facts, r.roles, r.since) for r in QUERIES["register_facts"](spark, str(tmp_path)).collect()}
    assert got == {7: (5, 3, day), 8: (1, 1, datetime(2001, 1, 1))}


def test_lexical_tasks_are_bounded_by_documents_and_queries(spark, monkeypatch):
    docs = spark.range(400).selectExpr("concat('files:', id) document_id", "concat('Docs/red_', id) path", "concat('red ', case when id % 3 = 0 then 'blue' else 'green' end, ' ', id) content")
    terms = spark.createDataFrame([(q, t) for q in range(30) for t in ("red", "blue", str(q))], "query_id long, term string")
    whole = sorted(map(tuple, lexical.bm25(docs, terms).collect())), sorted(map(tuple, lexical.best_field(docs, terms).collect()))
    monkeypatch.setattr(lexical, "HITS", 1000)
    assert lexical.parts(docs, terms, "query_id") == 13 and lexical.parts(docs, terms, "query_id", times=2) == 26
    hits, fields = lexical.bm25(docs, terms), lexical.best_field(docs, terms)
    assert (sorted(map(tuple, hits.collect())), sorted(map(tuple, fields.collect()))) == whole and len(whole[0]) == 400 * 30
    for df, n in ((hits, 13), (fields, 26)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(document_id#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
        assert "hashpartitioning(query_id" not in plan


def test_lexical_tasks_are_bounded_for_long_documents(spark, monkeypatch):
    docs = spark.range(40).selectExpr("concat('files:', id) document_id", "concat('Docs/', id) path", "array_join(transform(sequence(0, cast(id % 2 * 900 + 99 as int)), x -> concat('w', x)), ' ') content")
    docs = docs.union(spark.createDataFrame([("files:40", "Docs/40", None)], docs.schema))
    terms = spark.range(1000).selectExpr("id % 3 query_id", "concat('w', id) term")
    whole = sorted(map(tuple, lexical.bm25(docs, terms).collect()))
    monkeypatch.setattr(lexical, "HITS", 1000)
    n = lexical.parts(docs, terms, "query_id")
    assert n == -(-(20 * 1000 + 21 * lexical.MATCHED) // 1000)
    held = lexical.matches(docs, terms, n)
    assert held.where("term <> ''").count() == 20 * 1000 + 20 * 100
    assert sorted(map(tuple, lexical.bm25(docs, terms).collect())) == whole and len(whole) == 40 * 3


def test_texts_are_dealt_and_not_their_words(spark):
    docs = spark.range(90).selectExpr("concat('files:', id) document_id", "case when id % 9 = 0 then null else repeat('red blue ', cast(id % 4 as int)) end content")
    terms = spark.createDataFrame([(1, "red"), (1, "blue"), (2, "blue"), (2, "none")], "query_id long, term string")
    got = lexical.bm25(docs, terms, 7)
    dealt = got._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[1:]
    assert dealt and not any("Generate" in x.split("Range (")[0] for x in dealt)
    lengths = {i: 2 * (i % 4) for i in range(90) if i % 9}
    average = sum(lengths.values()) / len(lengths)
    df = sum(n > 0 for n in lengths.values())
    part = lambda n: log(1 + (90 - df + 0.5) / (df + 0.5)) * n / 2 * 2.2 / (n / 2 + 1.2 * (0.25 + 0.75 * n / average))
    want = {(q, f"files:{i}"): (round(part(n) * (3 - q), 6), 3 - q) for i, n in lengths.items() if n for q in (1, 2)}
    assert {(r.query_id, r.document_id): (r.score, r.matched) for r in got.collect()} == want


def test_hits_go_to_the_texts(spark, tmp_path):
    texts = ["red blue", "red", "green", None]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red"), (2, "blue")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in (("batch_budgets", 2), ("rerank_texts", 3), ("prefix_pack", 3), ("fair_share_pack", 3), ("json_pack", 2)):
            df = QUERIES[name](spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin [document_id#" in plan and "SortMergeJoin [document_id#" not in plan
            assert df.count() == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_identities_of_cells_of_many_blocks(spark, tmp_path):
    rng = random.Random(7)
    names = [f"{rng.choice(['Ada', 'Bob', ''])} {rng.choice(['', 'King '])}{rng.randint(0, 400):09d}" for _ in range(1200)]
    rows = [(i, n, 1, rng.choice([1200.0, 1499.0, 1400.0, -300.0, 400.0, None, float("nan")]), "HOME") for i, n in enumerate(names)]
    rows += [(5000, None, 1, 1.0, "HOME"), (5001, names[0], None, 1200.0, "HOME"), (5002, names[0], 2, 1200.0, "HOME")]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["identity_suggestions"](spark, str(tmp_path))
    assert "indel_ratio" not in got._jdf.queryExecution().executedPlan().toString()
    band = lambda v: v if v is None else "nan" if v != v else round(v / 1000)
    known, want = {}, {}
    folded = [(i, " ".join(n.lower().split()), band(b)) for i, n, _, b, _ in rows[:1200]]
    for i, x, s in folded:
        for j, y, t in folded:
            if i < j:
                pair = known.get((x, y)) or known.setdefault((x, y), text.indel(x, y))
                shared = 0.35 if s is not None and s == t else 0.0
                u, v = x.split(), y.split()
                name = 0.55 if x == y else 0.52 if len(u) > 1 < len(v) and (u[0], u[-1]) == (v[0], v[-1]) else next((w for least, w in ((96, 0.45), (92, 0.36), (88, 0.27)) if pair >= least), 0)
                if name and name + shared >= 0.5:
                    want[i, j] = (round(pair, 3), round(min(name + shared, 0.99), 3))
    assert {(r.id_a, r.id_b): (round(r.ratio, 3), r.score) for r in got.collect()} == want and got.count() == len(want)


def test_vector_scores_hold_few_queries_at_a_time():
    draw = np.random.default_rng(1)
    blocks = [(list(range(2048 * n, 2048 * n + 2048)), [f"d{i}" for i in range(2048)], draw.normal(size=(2048, 8)), list(range(2048)), draw.normal(size=(2048, 8))) for n in range(3)]
    columns = [[(x.tobytes() if isinstance(x, np.ndarray) else x) for x in c] for c in zip(*blocks, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ids", "names", "matrix", "query_ids", "queries"])
    tracemalloc.start()
    seen = {}
    for out in vector._nearest(5)(iter([batch])):
        for q, chunk, score in zip(*(out.column(c).to_pylist() for c in ("query_id", "chunk", "score")), strict=True):
            if q in (0, 127, 128, 2047):
                seen.setdefault((q, chunk // 2048), []).append((chunk, score))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for n, (ids, _, m, _, asked) in enumerate(blocks):
        for q in (0, 127, 128, 2047):
            s = np.round(asked[q] @ m.T, 6)
            assert seen[q, n] == [(ids[i], s[i]) for i in sorted(range(2048), key=lambda i: (-s[i], i))[:5]]
    assert peak < 16 << 20
