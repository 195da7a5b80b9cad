import datetime as dt
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import chunks, dates, paths, text
from lodestar.operators import components, dedup, fusion, lexical, pack, queue, sync
from lodestar.sources import mail, pages


@given(st.text(alphabet="ab. \n", max_size=300), st.integers(5, 60), st.integers(0, 80))
def test_chunks_cover_the_text(body, size, overlap):
    got = list(chunks.cut(body, size, overlap))
    assert all(len(p) <= size and p == p.strip() and p for _, p in got)
    kept = "".join(body.split())
    assert set(kept) == set("".join("".join(p.split()) for _, p in got)) or not kept
    assert [s for s, _ in got] == sorted({s for s, _ in got})


def test_chunk_takes_the_furthest_mark():
    body = "a" * 30 + "\n\n" + "b" * 20 + " " + "c" * 60
    assert next(chunks.cut(body, 60, 0))[1].endswith("b" * 20)


def test_adaptive_split():
    parts = chunks.adaptive_split("word " * 400, lambda p: len(p) <= 300)
    assert all(len(p) <= 300 for p in parts) and "".join("".join(parts).split()) == "word" * 400


@pytest.mark.parametrize(
    "title,body,value,confidence",
    [
        ("x", "Datum: 03.04.2021 text", "2021-04-03", 0.98),
        ("x", "Berlin, den 3. März 2020", "2020-03-03", 0.94),
        ("a/2019-05-06 plan.pdf", "no date", "2019-05-06", 0.88),
        ("a/plan 2018.pdf", "", "2018", 0.62),
        ("x", "seen 1.2.70 here", "1970-02-01", 0.8),
        ("x", "31.02.2020", "", 0.0),
        (None, None, "", 0.0),
    ],
)
def test_dates(title, body, value, confidence):
    got = dates.infer_date(title, body)
    assert (got["value"], got["confidence"]) == (value, confidence)


def test_two_digit_years():
    assert [dates.full_year(y) for y in ("69", "70", "1999")] == [2069, 1970, 1999]


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_indel_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0
    assert text.indel(a, b) == pytest.approx(want)
    assert text.indel(a, b) >= 100 * SequenceMatcher(None, a, b, autojunk=False).ratio() - 1e-9


def test_near_text():
    base = " ".join(f"w{i}" for i in range(300))
    assert dedup.near_text(base, base) and not dedup.near_text("short", "short")
    assert dedup.near_text(base, base.replace("w7 ", "x7 ")) and not dedup.near_text(base, base[: len(base) // 2])


def test_group_variants(spark):
    rows = [(1, "a", 1, "h", "d", "s", "pdf", ""), (1, "b", 2, "h", "e", "t", "pdf", ""), (1, "c", 3, None, "d", "s", "odt", ""), (1, "e", 4, None, "f", "s", "odt", "")]
    hits = spark.createDataFrame(rows, "query_id long, document_id string, rank int, hash string, dir string, stem string, suffix string, text string")
    got = {r.document_id: (r.rank, r.variants) for r in dedup.group_variants(hits).collect()}
    assert got == {"a": (1, ["b", "c"]), "e": (2, [])}
    assert dedup.group_variants(hits, most=1).count() == 1


def test_scopes():
    assert paths.normal_scopes(["Mail", "files"]) == ["mailarchive", "documents"] and paths.normal_scopes([" "]) is None
    with pytest.raises(ValueError):
        paths.normal_scopes(["nowhere"])


def test_fusion_ignores_the_order_of_arms(spark):
    hits = [(1, "files", "a", 1, 1.0), (1, "files", "b", 2, 1.0), (1, "vector", "b", 1, 1.0), (1, "vector", "c", 2, 1.0)]
    schema = "query_id int, arm string, document_id string, rank int, weight double"
    one, two = (fusion.weighted_rrf(spark.createDataFrame(h, schema)).orderBy("rank").collect() for h in (hits, hits[::-1]))
    assert one == two and [r.document_id for r in one] == ["b", "a", "c"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (50, 50)], "a int, b int")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[41] == 40
    assert {r.node: r.component for r in components.components(edges, hops=2).collect()}[20] == 18


def test_delta_and_upserts(spark):
    old = spark.createDataFrame([("a", "1", "v"), ("b", "1", "v"), ("c", "1", "u"), ("d", None, "v")], "document_id string, content_hash string, index_signature string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "9"), ("d", None)], "document_id string, content_hash string")
    assert dict(sync.delta(old, now, "v").collect()) == {"a": "unchanged", "b": "changed", "c": "reindex", "d": "unchanged", "e": "new"}
    assert "stale" not in {r.change for r in sync.delta(old, now.limit(0), "v", complete=False).collect()}
    once = sync.upsert(now, now, "document_id")
    assert sorted(once.collect(), key=str) == sorted(now.collect(), key=str)


def test_queue_order(spark):
    j = spark.createDataFrame([(3, "x", 1, "pending"), (2, "x", 1, "pending"), (1, "x", 5, "pending"), (0, "y", 0, "done")], "job_id int, document_id string, priority int, status string").withColumn("key", F.lit("k"))
    assert queue.claims(j, "key").first().job_id == 2


def test_packing_stays_in_budget(spark):
    r = spark.createDataFrame([(1, i, f"d{i}", "x" * 40) for i in range(1, 6)], "query_id long, rank int, document_id string, text string")
    kept = pack.prefix_pack(r, 100, 10).orderBy("rank").collect()
    assert [k.kept for k in kept] == [40, 40, 20] and kept[-1].cut
    assert pack.fit_json(r, 150).first().size <= 150


def test_query_tokens_and_phrases(spark):
    d = spark.createDataFrame([("a", "The big red house"), ("b", "red the big"), ("c", None)], "document_id string, content string")
    assert [r.document_id for r in d.where(lexical.phrase(F.col("content"), ["big", "red"])).collect()] == ["a"]
    assert [r.document_id for r in d.where(lexical.phrase(F.col("content"), ["the", "bi"], True)).collect()] == ["a", "b"]
    assert lexical.sloppy(d, "the", "house", 2).count() == 1 and lexical.sloppy(d, "the", "house", 1).count() == 0


def test_mail_and_cards():
    m = mail.read_message("Message-ID: <a@x>\nReferences: <p@x> <q@x>\nSubject: s\n\nbody")
    assert m["references"] == ["<p@x>", "<q@x>"] and m["body"] == "body"
    assert mail.read_message(None)["message_id"] is None
    c = mail.read_card("N:Doe;Jane\nitem1.TEL;TYPE=home:+1 2\nEMAIL:A@B.c\n d\nno colon")
    assert c == {"full_name": "Jane Doe", "emails": ["a@b.cd"], "phones": ["+1 2"], "organisation": None}


def test_pages():
    p = pages.read_page("<title>T &amp; u</title><meta property='og:site_name' content='S'><script>x</script><p>a  b<p>c")
    assert (p["title"], p["publisher"], p["text"]) == ("T & u", "S", "a b\nc")
    assert pages.read_page(None)["text"] == "" and pages.decode(b"\xe9", "latin-1") == "é" and pages.decode(b"a", "no-such") == "a"


def test_valid_calendar():
    assert dates.infer_date("", "2020-02-29")["value"] == dt.date(2020, 2, 29).isoformat()
