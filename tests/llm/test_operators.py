"""The ten operators against brute force, with nulls, empty and odd texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import bpe, components, exact_dedup, html_extract, media, ngram_join, pii, quality, source_mix, suffix_dedup, token_count
from lodestar.llm.common import Staged

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n", "a", "é", "word " * 3000, "x" * 5000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row int, size int, keep_id int"


def frame(spark, texts, sources=None):
    rows = [(i, t, None if i % 7 == 3 else "en", (sources or (lambda i: f"s{i % 3}"))(i), None, i, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed, n, words=40, vocabulary=500):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, words))) for _ in range(n)]


# op1


def test_article_text():
    html = """<!DOCTYPE html><html><head><title>x</title></head><body><nav><ul><li><a href="/a>b">menu</a></ul></nav><div class="ad">Buy a lot of things here now</div>
    <article><h1>T &amp; u</h1><p><b>Lead<br><p>One&nbsp;two
    three.</p><div class="cookie-notice">We use cookies</div><form><p>Sign up</p></form><section id="comments"><p>nice nice</p></section></article>
    <aside>side</aside><footer>&copy; foot</footer><script>if (a<b) "</p>"</script></body></html>"""
    assert html_extract.main_text(html) == "T & u\nLead\nOne two three."


PLAIN = "Some plain words that make up a paragraph of the text. " * 6
LINKED = '<p>Some <a href="/x">linked words</a> here in this short one.</p>'
SECTIONS = "".join(f"<section><h2>Part {i}</h2>{f'<p>{PLAIN}</p>' * 6}</section>" for i in range(3))
ITEMS = f"<ul>{'<li>An item of the list that has about fifty characters</li>' * 30}</ul>"
ROWS = f"<table><thead><tr><th>A<th>B</thead>{'<tr><td>one cell of the table<td>the other cell of it</tr>' * 60}</table>"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("link", ["", LINKED])
@pytest.mark.parametrize("parts", [SECTIONS, f"<p>{PLAIN}</p>" * 4 + ITEMS, ITEMS + f"<p>{PLAIN}</p>", f"<p>{PLAIN}</p>" * 2 + ROWS + "<p>End.</p>", f"<div>{SECTIONS}</div><p>End.</p>"])
def test_whole_articles(tag, link, parts):
    inner = f"<h1>Title</h1>{link}{parts}"
    page = f'<body><nav><a href="/">Home</a></nav><div><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></div><{tag}>{inner}</{tag}><footer>foot</footer></body>'
    assert html_extract.main_text(page) == "\n".join(html_extract.blocks(html_extract.parse(inner)))


@pytest.mark.parametrize("wrap", ['div class="page with-sidebar"', 'div class="content no-sidebar"', 'div class="single-post comments-open"', 'div class="layout has-header"', 'div class="card widget"', 'div id="social"', "form", 'div role="form"', 'div class="a"'])
@pytest.mark.parametrize("shell", ["{}", '<div class="sidebar"><p>Some words beside it.</p></div>{}<div id="comments"><p>I think so too.</p></div>'])
def test_layout_names_keep_the_article(wrap, shell):
    article = f"<h1>Title</h1><p>{PLAIN}</p><p>{LINKED[3:-4]} {PLAIN}</p><p>{PLAIN}</p>"
    got = html_extract.main_text(f"<body><nav><a href='/'>Home</a></nav><{wrap}>{shell.format(article)}</{wrap.split()[0]}><footer>foot</footer></body>")
    assert got == "\n".join(html_extract.blocks(html_extract.parse(article)))


def test_long_comments_go_where_an_article_stands():
    page = f'<body><article><h1>Title</h1><p>{PLAIN}</p><p>{PLAIN}</p></article><div id="comments">{f"<p>{PLAIN}</p>" * 3}</div></body>'
    assert html_extract.main_text(page) == "\n".join(["Title", PLAIN.strip(), PLAIN.strip()])


def densities(node, root):
    """(characters, tags, link characters, link tags) and the density, straight from the formula."""

    def count(n, linked=False):
        linked = linked or n.tag == "a"
        c = lc = t = lt = 0
        for k in n.kids:
            if isinstance(k, str):
                size = len("".join(k.split()))
                c, lc = c + size, lc + size * linked
            else:
                a, b, d, e = count(k, linked)
                c, t, lc, lt = c + a, t + b + (k.tag != "br"), lc + d, lt + e + (k.tag == "a")
        return c, t, lc, lt

    (c, t, lc, lt), (cb, _, lcb, _) = count(node), count(root)
    if not c:
        return 0.0
    t, share = max(1, t), lcb / max(1, cb)
    ratio, base = c / max(1, lc) * t / max(1, lt), np.log(c / max(1, c - lc) * lc + share * c + np.e)
    return c / t * (np.log(ratio) / np.log(base) if base > 1 and ratio > 1 else 1e-3)


@pytest.mark.parametrize("parts", [SECTIONS, ITEMS + LINKED * 3, ROWS + LINKED, f"<div>{LINKED}<div>{SECTIONS}</div></div>"])
def test_densities_are_those_of_the_formula(parts):
    root = html_extract.parse(f"<body><div><a href='/'>Home</a></div>{parts}</body>")
    order = html_extract.score(root)
    for node in order:
        assert node.density == pytest.approx(densities(node, root))
        assert node.total == pytest.approx(sum(k.density for k in node.kids if not isinstance(k, str)))


def test_end_tags_take_constant_time():
    import time

    def took(n):
        began = time.process_time()
        html_extract.parse("<p><b>" + "<div><i>" * n + "</p></b></em>" * n + "</div>" * n)
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 12 * took(4_000) + 0.2


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<!-- never closed", "<script>", "</p></p>", "<a href='"])
def test_broken_pages_have_no_text_or_plain_text(html):
    assert html_extract.main_text(html) in ("", "<", "<p", "<a href='")


def test_deep_pages():
    assert html_extract.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages.withColumn("text", F.lit(1))).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html_extract.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# op2


def fair_targets(sizes, weights, share=Fraction(3, 2), cap=2):
    left, out, open_ = share * sum(sizes), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if rate * weights[i] > cap * sizes[i]]
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        if not full:
            for i in open_:
                out[i] = rate * weights[i]
            break
        open_ = [i for i in open_ if i not in full]
    return [float(t) for t in out]


@pytest.mark.parametrize("sizes", [[100, 100, 1000], [0, 0], [5], [1, 1, 1, 10**6, 3, 40, 0, 10**13], []])
def test_targets_stop_at_the_cap(spark, sizes):
    weights = [3, 1, 2, 3, 1, 2, 3, 1][: len(sizes)]
    got = source_mix.with_targets(spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "source_no int, source_size long, weight int"))
    assert [r.target for r in got.orderBy("source_no").collect()] == fair_targets(sizes, weights)


@given(st.integers(1, 400), st.integers(0, 5))
@settings(deadline=None, max_examples=50)
def test_permutation(n, key):
    assert sorted(source_mix.permuted(np.arange(n), n, key).tolist()) == list(range(n))


@given(st.integers(1, 400), st.integers(0, 5))
@settings(deadline=None, max_examples=50)
def test_inverse_permutation(n, key):
    at = np.arange(n)
    assert (source_mix.permuted(source_mix.permuted(at, n, key), n, key, inverse=True) == at).all()


@given(st.integers(0, 300), st.integers(0, 150), st.integers(1, 40))
@settings(deadline=None, max_examples=300)
def test_quotas_meet_their_words(words, size, block_words):
    words = min(words, 2 * size)
    slots, part = source_mix.quota(words, size, block_words, 3)
    blocks, taken = -(-size // block_words), 0
    for j in range(slots):
        block = int(source_mix.permuted(np.array([j % blocks]), blocks, source_mix._key(3, j // blocks))[0])
        held = min(size, (block + 1) * block_words) - block * block_words
        if j == slots - 1 and part is not None:
            assert 0 < part < held
            held = part
        taken += held
    assert taken == words


@pytest.mark.parametrize("slots,shards", [(100, 8), (7, 100), (0, 3)])
def test_shards_meet_their_quotas(slots, shards):
    at, counts = source_mix.draw_shards(slots, shards, 1)
    assert counts.sum() == slots and (counts > 0).all() and len(set(at.tolist())) == len(at) and all(0 <= x < shards for x in at)


@pytest.mark.parametrize("options", [{}, {"block_words": 16, "shard_slots": 20}])
def test_mix(spark, options):
    docs = frame(spark, ODD + prose(1, 400, 200), lambda i: None if i % 5 == 0 else f"s{i}" if i % 90 == 1 else f"s{min(i % 4, 2)}")
    docs = docs.unionByName(docs.where("doc_id % 50 = 9")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    rows = source_mix.mix_report(docs, **options).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, source_mix.mix_report(docs.repartition(5), **options).collect()))
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))), F.lit(0)).alias("n")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, fair_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    source_of = {r.doc_id: r.source for r in docs.collect()}
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        source = source_of[r.doc_id]
        taken[source] += r.taken
        assert (r.source_size, r.target) == (sizes[source], goal[source])
    assert all(abs(taken[n] - goal[n]) <= 1 for n in names)
    made = source_mix.mixed_documents(docs, **options).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).alias("n"))
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.taken
    assert {r.doc_id: r.n for r in made.collect()} == {d: n for d, n in total.items() if n}
    assert source_mix.mix_report(docs.limit(0), **options).count() == 0
    assert source_mix.mix_report(docs.where("trim(text) = ''"), **options).where("target <> 0 or taken <> 0").count() == 0


# op3


def test_quality(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "plain", "words", "here"]) + ("" if i % 4 else "###") for _ in range(30)) for i in range(600)]
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 600, 2)] + [(None, 1, 0), (10**6, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts) + len(ODD)
    held = [i for i in range(1, 600, 2)]
    assert sum(got[i].quality_kept == (i % 4 != 0) for i in held) / len(held) > 0.95
    assert all(r.quality_kept for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = labels.where("doc_id % 3 = 0")
    scored = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(test, "doc_id").collect()
    good = [r.quality_kept for r in scored if r.quality == 1]
    assert sum(good) / len(good) > 0.95
    bad = [r.quality_kept for r in scored if r.quality == 0]
    assert sum(bad) / len(bad) < 0.5


# op4


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_similarity_components(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    near = []
    for _ in range(150):
        w = list(base)
        for j in rng.sample(range(100), rng.randint(0, 5)):
            w[j] = f"x{rng.randrange(10**6)}"
        near.append(" ".join(w))
    common = " ".join(f"p{i}" for i in range(40))
    texts = ODD + near + prose(2, 300, 14, 5) + [f"{t} {common}" for t in prose(3, 80, 20, 10**6)] + ["a b c", "A B C", "a b c d e", "a b c d e f"]
    got = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert all((got[i].component_id, got[i].n_shingles) == (root(i), len(s)) for i, s in enumerate(sets))
    assert ngram_join.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = frame(spark, ["a b c d e f g"] * 3 + ["", "", None, "other words are here now"])
    assert sorted(r.doc_id for r in ngram_join.one_per_group(docs).collect()) == [0, 3, 4, 5, 6]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)]))
        if ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b)):
            assert ngram_join.may_link(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(Staged(spark), links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


# op5


@pytest.mark.parametrize("bits,capacity", [(64, 32 << 20), (3, 32 << 20), (64, 100), (2, 300)])
def test_exact_groups(spark, bits, capacity):
    texts = ODD + ["a b", "ab", "a  b", "A b", "é x", "éx"] + prose(6, 100, 2, 4)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts), capacity=capacity, hash_bits=bits).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\\x20\\x09-\\x0D]", "", t or "")].append(i)
    for body, members in groups.items():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = frame(spark, ["same text", "other"])
    assert sorted(r.text for r in exact_dedup.deduplicate(docs.unionByName(docs)).collect()) == ["other", "same text"]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_directory_doubles():
    cell = lambda p, n, one=False: (p << 56, 8, n, one)
    d = exact_dedup.Directory([cell(0, 10), cell(1, 10), cell(128, 3), cell(255, 50, True)], capacity=12)
    assert d.depth == 8 and d.starts[0] == 0 and d.ways[-1] == 5 and len(d) == len(d.starts) + 4
    at = np.array([0, 1 << 56, 128 << 56, 129 << 56, 255 << 56], np.uint64)
    owner, ways = d.find(at, np.arange(5))
    assert owner[0] != owner[1] and owner[2] == owner[3] and ways.tolist() == [1, 1, 1, 1, 5]
    assert len(exact_dedup.Directory([], 12)) == 1


def test_index_refines_prefixes(spark):
    rows = [(i << 44, 2, 100) for i in range(64)] + [(7 << 60, 10**6, 100)]
    d = exact_dedup.index(spark.createDataFrame(rows, "hash long, n long, bytes long"), 1000, 1000)
    assert d.depth > 12 and d.ways.max() > 50
    owner, _ = d.find(np.array([r[0] for r in rows[:64]], np.uint64), np.arange(64))
    assert len(set(owner.tolist())) >= 16


# op6


@pytest.mark.parametrize("around_bits", [64, 0, 2])  # with few bits surroundings collide, in batches and across them
def test_suffix_dedup(spark, around_bits):
    rng = random.Random(7)
    letters = "abcdefgh "
    passage = "".join(rng.choice(letters) for _ in range(150))
    noise = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    texts = ODD + ["x" * 99, "x" * 100, "é" * 60] + [noise(120) + passage[rng.randint(0, 40) :] + noise(120) for _ in range(60)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) * rng.randint(1, 40) for _ in range(40)]
    big = "".join(rng.choice(letters) for _ in range(1_300_000))
    texts += [big, "q" + big[500_000:]]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), around_bits=around_bits).collect()}
    seen = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, bytes(r.kept)) == (len(data), sum(gone), hashlib.sha256(kept).hexdigest(), kept)
        assert r.n_spans == len(re.findall(b"\1+", bytes(gone)))
    assert suffix_dedup.remove_repeats(frame(spark, ["x"]).limit(0)).count() == 0


def test_suffix_sort_survives_collisions():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, (60, 12), dtype=np.uint8)
    sizes = rng.integers(1, 13, 60)
    s = suffix_dedup.Suffixes(data, sizes)
    want = sorted(data[i, : sizes[i]].tobytes() for i in range(60))
    order, common = s.sort()
    assert [data[i, : sizes[i]].tobytes() for i in order] == want
    s.prefix[:] = 0  # every comparison now collides
    order, _ = s.sort()
    assert [data[i, : sizes[i]].tobytes() for i in order] == want
    for x, y, n in zip(want, want[1:], common[1:], strict=False):
        assert x[:n] == y[:n] and (len(x) == n or len(y) == n or x[n] != y[n])


# op7


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)


def test_bpe_matches_the_library(spark, tokenizer):
    rng = random.Random(8)
    letters = "aabbccttheing   \n\t\x0b\x1c\x85\xa0 é½²٣一😀'’.,-_0123ſK͸\0"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + ("<|endoftext|>" if i % 5 == 0 else "") + rng.choice("ab -") * rng.randint(0, 140) for i in range(1500)]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, ["x"]).limit(0)).count() == 0


def test_gadgets_of_equal_parts():
    a = bpe.Automaton({0: b"a", 1: b"b", 2: b"aa", 3: b"aaaa"}, [(0, 0, 2), (2, 2, 3)], {})
    assert [list(a.run(b"a" * n)) for n in (1, 2, 3, 5, 7)] == [[0], [2], [2, 0], [3, 0], [3, 2, 0]]


# op8


def brute_count(word, scores):
    spelled = token_count.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(spelled) + 1):
        size = len(spelled[end - 1].encode())
        options = [(best[end - 1][0] + token_count.BYTE_SCORE * size, best[end - 1][1] + size)]
        options += [(best[s][0] + scores[spelled[s:end]], best[s][1] + 1) for s in range(end) if spelled[s:end] in scores]
        top = max(o[0] for o in options)
        best.append(min((o for o in options if o[0] == top), key=lambda o: o[1]))
    return best[-1][::-1]


def test_token_counts(spark):
    scores = {p: token_count.rank_score(i) for i, p in enumerate(token_count.read_model(token_count.DEFAULT_MODEL))}
    texts = ODD + prose(9, 30) + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()] + ["ſtrange 一二 \x00"]
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        parts = [brute_count(w, scores) for w in token_count.WORD.findall(t or "")]
        assert (got[i].n_words, got[i].n_tokens) == (len(parts), sum(p[0] for p in parts))
        assert got[i].score == pytest.approx(sum(p[1] for p in parts))


# op9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, pattern in enumerate(BASE.values()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_personal_data(spark):
    rng = random.Random(10)
    bits = ["1", "23", "4111 1111 1111 1111", "+", "@", "a.b", "x", "x@y.z", ".", "-", " ", "(", "é😀", "127.0.0.1", "0255.1.1.1", "256.1.1.1", "+1 (234) 567-8901", "55-66", "a@b.c_d@e.f"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["1 2 " * 20000, "a" * 60000, "1" * 50000, "a.b@" * 2000]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == [s for s in want.split(",") if s]
    assert pii.personal_data(frame(spark, ["x"]).limit(0)).count() == 0


def test_revealing_terms(spark):
    texts = prose(11, 200, 30, 40)
    for i in range(0, 200, 20):
        texts[i] += f" zorblatt bob@x.org n{i}"
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all((got[i].n_term == 1) == (i % 20 == 0) for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[20].endswith("[TERM] [EMAIL] n20") and clean[1] == texts[1]


@pytest.mark.parametrize("n", [1, 2])
def test_rare_values_have_revealing_terms(spark, n):
    texts = prose(12, 400, 30, 40)
    for i in range(n):
        texts[i] += " zorblatt bob@x.org"
    docs = frame(spark, texts + texts[-1:] * 3)
    got = {r.doc_id: r.n_term for r in pii.personal_data(docs).collect()}
    assert all(got[i] == (i < n) for i in range(len(texts)))


def test_revealing_terms_stand_anywhere_in_the_text(spark):
    texts = prose(13, 400, 30, 40)
    far = " ".join(["w1"] * 40)
    texts[5] = f"Bo Zorblatt {far} x@y.org bob@x.org, {far} zorblatt w2 BO"
    docs = frame(spark, texts + [texts[5]])  # a copy
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    words = [(m.start(), m.end()) for m in re.finditer("bo |zorblatt|bo$", texts[5].lower())]
    want = [f"term:{a}:{a + len(texts[5][a:b].strip())}" for a, b in words]
    for i in (5, 400):
        assert [x for x in got[i].spans.split(",") if x.startswith("term")] == want and got[i].n_email == 2
    assert all(got[i].n_term == 0 for i in range(400) if i != 5)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[5] == clean[400] == f"[TERM] [TERM] {far} [EMAIL] [EMAIL], {far} [TERM] w2 [TERM]"


def test_terms_against_brute_force(spark):
    """Every (value, term) pair scored straight from the formula."""
    rng = random.Random(14)
    values = ["bob@x.org", "+49 123 456 7890", "10.0.0.1", "al@b.co"]
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 12))]
        for v in values[: rng.randint(0, 2)] if i % 3 else [rng.choice(values)]:
            words.insert(rng.randint(0, len(words)), v + rng.choice(["", "", "zz"]))
        texts.append(" ".join(words))
    texts += texts[:5] + [None, ""]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.personal_data(frame(spark, texts), disclosure=0.3).collect()}
    bases = [[(int(s), int(e), k, (t or "")[int(s) : int(e)].lower()) for k, s, e in (x.split(":") for x in base_spans(t).split(",") if x)] for t in texts]
    terms = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"(?<![^\W_])[^\W_]{1,40}(?![^\W_])", t or "") if not any(s < m.end() and e > m.start() for s, e, *_ in b)] for t, b in zip(texts, bases, strict=True)]
    distinct = {t or "": i for i, t in enumerate(texts)}
    n_term = collections.Counter(w for t in texts for w in {m[0].lower() for m in re.finditer(r"(?<![^\W_])[^\W_]{1,40}(?![^\W_])", t or "")})
    pairs, held = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        for v in {(k, m) for _, _, k, m in bases[i]}:
            held[v].add(t)
            for w in {w for *_, w in terms[i]}:
                pairs[v, w].add(i)
    marked = collections.defaultdict(set)
    for (v, w), docs in pairs.items():
        k, total = len({texts[i] for i in docs}), len(distinct)
        score = 1 + np.log((k + 0.5) / (k + 1) * len(docs) / n_term[w]) / np.log(total / len(held[v]))
        if score >= 0.3:
            for t in {texts[i] for i in docs}:
                marked[t].add(w)
    for i, t in enumerate(texts):
        assert got[i] == [f"term:{a}:{b}" for a, b, w in terms[i] if w in marked[t]], i
    assert sum(map(len, got.values())) > 10


def test_many_spans_in_one_text(spark):
    import time

    texts = [" ".join(f"word{i % 50} user{i}@example.org" for i in range(10_000)), "plain"]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    assert got[0].n_email == 10_000 and got[0].base_sha256 == hashlib.sha256(base_spans(texts[0]).encode()).hexdigest()
    assert time.monotonic() - began < 90


# op10


@pytest.mark.parametrize("kind", [None, *range(5)])
def test_png_round_trip(kind):
    for size in (0, 1, 64, 65, 100_000):
        payload = media.pad_payload(bytes(random.Random(size).randbytes(size)))
        assert media.decode_png(media.encode_png(payload, kind)).tobytes() == payload


def test_all_filters_are_undone():
    rng = np.random.default_rng(2)
    rows, kinds = rng.integers(0, 256, (40, 64), dtype=np.uint8), rng.integers(0, 5, 40)
    lines = np.empty_like(rows)
    for y in range(40):
        for x in range(64):
            left = int(rows[y, x - 1]) if x else 0
            up = int(rows[y - 1, x]) if y else 0
            corner = int(rows[y - 1, x - 1]) if x and y else 0
            near = min((left, up, corner), key=lambda v, b=left + up - corner: abs(b - v))
            lines[y, x] = (int(rows[y, x]) - (0, left, up, (left + up) // 2, near)[kinds[y]]) & 255
    image = np.column_stack([kinds.astype(np.uint8), lines])
    other = np.column_stack([np.full(3, media.UP, np.uint8), np.ones((3, 64), np.uint8)])
    for images in ([image], [other, image, image[:1], other] * 9):
        for lines, got in zip(images, media.unfilter_all(images), strict=True):
            want = np.cumsum(np.ones((3, 64), np.uint8), axis=0) if lines is other else rows[: len(lines)]
            assert (got == want).all()
    assert media.unfilter_all([]) == []
    with pytest.raises(media.MediaError):
        media.unfilter_all([np.full((1, 65), 5, np.uint8)])


def test_rows_take_different_filters():
    text = ("The quick brown fox jumps. " * 40 + "".join(chr(32 + i % 90) for i in range(4000))).encode()
    kinds = set(media.read_png(media.encode_png(media.pad_payload(text + bytes(range(256)) * 8)))[:, 0].tolist())
    assert len(kinds) > 2


def test_damage_is_found():
    good = media.encode_png(media.pad_payload(b"hello"))
    for at in (3, 20, len(good) // 2, len(good) - 1):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(good[:-12])


def test_media_columns(spark):
    texts = ODD + ["same", "same"]
    got = {r.doc_id: r for r in media.media_columns(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        payload = media.pad_payload((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.feature) == 16
    assert got[len(texts) - 1].feature == got[len(texts) - 2].feature
