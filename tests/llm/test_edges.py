"""Null ids, repeated rows, clashing columns and empty tables, operator by operator and stage by stage."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline
from lodestar.llm import bpe, exact_dedup, html_extract, media, ngram_join, pii, quality, source_mix, suffix_dedup, token_count
from lodestar.llm.common import ROW, set_aside

SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {ROW} string, size string, taken string, row string, hash string"
LONG = "some words that go on and on for a while until a hundred bytes are full and then some more of them follow here"
TEXTS = [(1, LONG), (1, LONG), (None, LONG), (None, f"  {LONG}"), (None, None), (2, ""), (2, "a b"), (3, "a  b"), (3, None), (4, "ab"), (5, f"x {LONG} y")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 2 else "en", None if n % 3 else "s", None, f"r{n}", "1", "2", "3", "4") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def bodies():
    return [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in TEXTS]


def test_exact_groups_of_null_and_repeated_ids(docs):
    groups = collections.defaultdict(list)
    for (doc, text), body in zip(TEXTS, bodies(), strict=True):
        groups[body].append((-len(text or ""), doc is None, doc or 0, doc))
    rows = exact_dedup.exact_groups(docs).collect()
    got = collections.Counter((r.text_sha256, r.group_size, r.keep_id) for r in rows)
    want = collections.Counter()
    for body, members in groups.items():
        want[hashlib.sha256(body.encode()).hexdigest(), len(members), min(members)[3]] = len(members)
    assert got == want and sum(r.kept for r in rows) == len(groups)


def test_kept_rows_keep_clashing_columns(docs):
    for kept in (exact_dedup.deduplicate(docs), ngram_join.one_per_group(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(r in docs.collect() for r in rows) and len(set(rows)) == len(rows)
    assert len(exact_dedup.deduplicate(docs).collect()) == len(set(bodies()))


def test_set_aside_finds_a_free_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], f"a int, {ROW} int, {ROW}_0 int")
    moved, back = set_aside(df)
    assert ROW not in moved.columns and moved.withColumnsRenamed(back).columns == df.columns


def test_components_of_null_and_repeated_ids(docs):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    n = len(LONG.split()) - 4
    assert got == {(1, n, 1): 2, (None, n, 1): 2, (5, n + 2, 1): 1, (None, 0, None): 1, (2, 0, 2): 1, (2, 1, 2): 1, (3, 1, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1}


def test_repeats_of_null_ids_come_last(docs):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r[ROW]), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    size = len(LONG)
    assert [x[1:] for x in rows] == [(size, 0), (size, size), (0, 0), (3, 0), (4, 0), (0, 0), (2, 0), (size + 4, size), (size, size), (size + 2, size + 1), (0, 0)]  # a blank before it stands in 5 too


@pytest.mark.parametrize("of", [bpe.encode_documents, token_count.count_tokens, media.media_columns, pii.personal_data, source_mix.mix_report])
def test_one_row_for_each_row(docs, of):
    got = of(docs)
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(i for i, _ in TEXTS)
    assert of(docs.limit(0)).count() == 0 and of(docs.limit(0)).columns == got.columns


def test_quality_passes_all_columns(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.columns == [*docs.columns, "quality_score", "quality_kept"] and got.count() == len(TEXTS)
    assert quality.features(b"x", None, None).tolist() != quality.features(b"x", "None", "None").tolist()


def test_null_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", None, "y"), (1, None, "<p>a</p>", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()) == [(0, "", "", 0), (1, "", "a", 1), (1, "u", "", 0)]


@pytest.mark.parametrize("some", [True, False])
def test_stages_with_nulls_and_empty_tables(spark, docs, tmp_path, some):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs if some else docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, str(tmp_path))
        assert got.columns == list(corpus_pipeline.COLUMNS)
        assert got.count() <= 2 * rows.count()
    assert corpus_pipeline.tokens(spark, rows, str(tmp_path)).count() == rows.count()
