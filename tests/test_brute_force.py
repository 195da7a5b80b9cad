"""Queries without SQL against plain Python over the whole result."""

import collections
import hashlib
import json
import re
import unicodedata

import pytest

from lodestar import catalogue
from lodestar.catalogue.curation import embedded
from lodestar.catalogue.operations import records
from lodestar.functions import embedding
from lodestar.plans import intents, planner

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def pieces(text, size, overlap, floor):
    """The rule by trying every end: the last blank or line end past the floor, else the size."""
    body, start, out = (text or "").strip(), 0, []
    while start < len(body):
        end = min(len(body), start + size)
        if end < len(body):
            ends = [e for e in range(start + max(1, int(size * floor)), end) if body[e] in " \n"]
            end = ends[-1] if ends else end
        if body[start:end].strip():
            out.append((start, body[start:end].strip()))
        if end == len(body):
            break
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("name,size,overlap,floor", [("document_chunks", 1200, 200, 0.5), ("graph_chunks", 3000, 0, 0.7)])
def test_chunks(spark, name, size, overlap, floor):
    got = collections.defaultdict(list)
    for r in rows(spark, name):
        got[r.document_id].append((r.chunk_no, r.start, r.size))
    for d in table(spark, "documents"):
        assert sorted(got[f"files:{d.doc_id}"]) == [(i, s, len(p)) for i, (s, p) in enumerate(pieces(d.text, size, overlap, floor))]


def test_folded_names(spark):
    names = {r.c_custkey: r.c_name for r in table(spark, "customer")}
    for r in rows(spark, "folded_names"):
        plain = unicodedata.normalize("NFKC", f"{names[r.c_custkey]} ßﬁ").casefold()
        assert r.name == re.sub(r"\s+", " ", re.sub("[^0-9a-zäöüßà-ž]+", " ", plain)).strip()
        ascii_ = unicodedata.normalize("NFKD", f"é mit {names[r.c_custkey]}").encode("ascii", "ignore").decode().upper()
        assert re.sub("[^A-Z0-9]+", "_", ascii_).strip("_")[:64] == r.predicate


def test_json_pack(spark):
    pools = collections.defaultdict(list)
    for r in records(spark, SF).collect():
        pools[r.query_id].append((r.rank, r.document_id, r.text))
    got = {r.query_id: r for r in rows(spark, "json_pack")}
    assert got.keys() == pools.keys()
    for query, pool in pools.items():
        kept, size = [], lambda x: len(json.dumps(x, ensure_ascii=False))
        for _, doc, text in sorted(pool):
            cuts = [n for n in range(len(text), 0, -1) if size([*kept, {"id": doc, "text": text[:n]}]) <= 12_000][:1]
            if cuts:
                kept.append({"id": doc, "text": text[: cuts[0]]})
            if cuts != [len(text)]:
                break
        payload = json.dumps(kept, ensure_ascii=False)
        assert (got[query].n_records, got[query].size, got[query].payload) == (len(kept), len(payload), hashlib.md5(payload.encode()).hexdigest())


def test_longest_mentions(spark):
    texts = {r.item_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in table(spark, "benchmark")}
    forms = collections.defaultdict(set)
    for r in table(spark, "benchmark"):
        if m := re.search("([a-zA-Z]{6,}) ", r.text):
            forms[m[1].lower()].add(r.item_id)
    known = collections.defaultdict(set)
    for word, ids in forms.items():
        known[word].add(f"E{min(ids)}")
    for r in table(spark, "benchmark"):
        if m := re.search("([a-zA-Z]+ [a-zA-Z]+) ", r.text):
            known[m[1].lower()].add(f"T{r.item_id}")
    want = set()
    for item, words in texts.items():
        found = [(-n, p, e) for n in (1, 2) for p in range(len(words) - n + 1) for e in known.get(" ".join(words[p : p + n]), ())]
        taken = set()
        for n, p, e in sorted(found):
            places = set(range(p, p - n))
            if not places & taken:
                taken |= places
                want.add((item, p, -n, e))
    assert {(r.text_id, r.pos, r.size, r.entity_id) for r in rows(spark, "longest_mentions")} == want


def test_embedding_halves_what_is_refused():
    calls = []

    def model(texts):
        calls.append(len(texts))
        return embedding.limited(300)(texts)

    texts = ["short", "w " * 400, "x" * 1000, "", "end"]
    got = list(embedding.vectors(texts, model, 50))
    assert [g[0] for g in got] == sorted(g[0] for g in got) and {g[0] for g in got} == set(range(5))
    assert all(len(t) <= 300 and v == [float(len(t)), 0.25] for _, _, t, v in got)
    assert [p for n, p, *_ in got if n == 2] == list(range(sum(n == 2 for n, *_ in got)))
    assert "".join(t for n, _, t, _ in got if n == 2).count("x") >= 1000 and calls[0] == 5
    with pytest.raises(embedding.TooLong):
        list(embedding.vectors(["ab"], embedding.limited(0), 0))


def test_resilient_embedding_keeps_every_chunk(spark):
    got = embedded(spark, SF).collect()
    assert got and all(len(r.text) <= 600 and r.vector[0] == len(r.text) for r in got)
    chunks = {(r.document_id, r.chunk_no) for r in rows(spark, "document_chunks") if int(r.document_id[6:]) % 100 == 0}
    assert {(r.document_id, r.chunk_no) for r in got} == chunks


def test_mail_messages(spark):
    turns = {(r.conv_id, r.turn): r for r in table(spark, "conversations")}
    want = {(f"mail:{c}.{t}", f"mail:{c}.{t - 1}" if t else None, f"Thread {c}" if not t else None) for c, t in turns}
    got = rows(spark, "mail_messages")
    assert {(r.message_key, r.parent, r.subject if r.parent is None else None) for r in got} == want and len(got) == len(table(spark, "conversations"))
    assert all(r.sender == f"{turns[r.conv_id, r.turn].role}@example.org" for r in got)


@pytest.mark.parametrize(
    "text,broad",
    [("Was gibt es zu Ada Lovelace", True), ("Ada Lovelace", True), ("Rechnungen von Ada Lovelace", False), ("Dokumente zu Ada Lovelace aus 2019", False), ("Infos zu ada lovelace vom 3.4.", False)],
)
def test_broad_questions(spark, text, broad):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text, "Ada Lovelace", 1)], "t string, m string, n int")
    assert df.select(planner.broad_entity(F.col("t"), F.col("m"), F.col("n"))).first()[0] == broad
    assert not df.select(planner.broad_entity(F.col("t"), F.col("m"), F.lit(2))).first()[0]


@pytest.mark.parametrize("text,wanted", [("wie viele Belege", True), ("Wie viele " + "langer " * 12 + "Belege", False), ("Belege alle", False), ("alle neuen Briefe", True), ("eine vollständige Übersicht", True), ("", False)])
def test_exhaustive_questions(spark, text, wanted):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(intents.exhaustive(F.col("t"))).first()[0] == wanted
