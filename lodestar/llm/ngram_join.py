"""Similarity join of documents on word shingles, by token-combination prefixes.

A document's tokens are its distinct shingles. Two documents of sizes n with Jaccard similarity of
3/4 or more differ in at most n // 4 tokens of either. In a global order (rare tokens first), a
prefix that more than n // 4 changes are needed to break must share a signature with the other's:

- a rare token is a signature by itself, and survives until it is changed;
- frequent tokens are dealt to small classes by hash, as many as the size level asks for; the
  signatures of a class are its two-token combinations, which c - 1 changes of c tokens break.
  The prefix is extended, class by class, until enough changes are covered.

Both documents of a pair use the classes of the larger one's level (a power of two), so a document
near the end of a level also signs at the next.

Token frequencies come from all documents: each task counts hashed tokens in a table of fixed size,
the tables are summed, and their sum (4 MB) is broadcast. Frequencies only steer order and classes;
results don't depend on them.

Documents meet in signature buckets. No bucket emits all its pairs: its members are paired with one
pivot, the document richest in frequent tokens. Parity bitmaps bound the overlap from above and drop
what can't link; the rest is verified on the full sets, and components are formed. Then, in buckets
that still hold several components, the members outside the largest one are compared with all
members, which completes the join: every pair that shares a signature is tested or connected
already. This last comparison goes by blocks of bitmaps, once per pair of blocks and not per shared
signature, and only pairs that the bitmaps leave possible become rows.

Equal sets of one task batch stand as one node. Words are hashed to 64 bits each, shingles to 64.

Cases: null and empty texts have no tokens and link with nothing; texts with fewer words than a
shingle are one token; very long texts are read whole; repeated rows link with each other; ties go
to the smallest doc_id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import ROW, Staged, binary_column, pieces, set_aside, source_rows, splitmix
from lodestar.llm.components import components

SHINGLE = 5
SIMILAR = 75  # per cent
TABLE_BITS = 20
TABLE_PARTS = 64
FREQUENT = 24  # documents, above what other tokens put into the same slot
SMALL_LEVEL = 4
PER_CLASS = 4
MAX_WORDS = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def token_set(text: bytes, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the words between ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(w))
    x = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        x = x * _P + w[i : i + len(x)]
    return np.unique(splitmix(x + np.uint64(size)))


def level(n: int) -> int:
    return n.bit_length() - 1


def signatures(tokens: np.ndarray, counts: np.ndarray, noise: float) -> np.ndarray:
    """The signatures of a token set under the frequency table."""
    n = len(tokens)
    need = n // 4 + 1
    seen = counts[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    rare = seen <= noise + FREQUENT
    singles = tokens[rare]
    if len(singles) >= need:
        order = np.lexsort((singles, seen[rare]))
        return singles[order[:need]]
    out = []
    for at in {level(n), level(-(-4 * n // 3))}:
        if at < SMALL_LEVEL:
            order = np.lexsort((tokens, seen))
            out.append(tokens[order[:need]])
        else:
            out += [singles, *_combined(tokens[~rare], need - len(singles), at)]
    return np.unique(np.concatenate(out))


def _combined(tokens: np.ndarray, need: int, at: int) -> list[np.ndarray]:
    mixed = splitmix(tokens + np.uint64(at))
    owner = mixed % np.uint64((1 << at) // PER_CLASS)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    edges = np.flatnonzero(np.diff(owner)) + 1
    out = []
    for start, stop in zip([0, *edges], [*edges, len(tokens)], strict=True):
        if need <= 0:
            break
        if stop - start < 2:
            continue
        own = tokens[start:stop]
        a, b = np.triu_indices(len(own), 1)
        out.append(splitmix(splitmix(own[a] + np.uint64(at)) * _P + own[b]))
        need -= len(own) - 1
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' slots, as many bits as the next power of two above the set's size, 64 at least."""
    bits = 1 << max(6, level(max(1, len(tokens))) + 1)
    slots = ((tokens * _P) >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sizes and parities leave the overlap that the similarity asks for."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return linked((n + m - apart) // 2, n, m)


def linked(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= SIMILAR * (n + m - overlap)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _batch_sets(batch: pa.RecordBatch, hashes: WordHashes, shingle: int) -> list[np.ndarray]:
    return [token_set(t, hashes, shingle) for t in binary_column(batch.column("text"))]


def _frequency_parts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = np.zeros(1 << TABLE_BITS, np.int64), WordHashes()
        for batch in pieces(batches, "text"):
            tokens = np.concatenate([np.empty(0, np.uint64), *{x.tobytes(): x for x in _batch_sets(batch, hashes, shingle)}.values()])
            table += np.bincount((tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table))
        kind = np.int32 if table.max() < 1 << 31 else np.int64
        parts = np.split(table.astype(kind), TABLE_PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TABLE_PARTS), pa.int32()), pa.array([kind().itemsize] * TABLE_PARTS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "width", "counts"])

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, width, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(counts, np.int32 if width == 4 else np.int64)
            sums[part] = sums[part] + values if part in sums else values.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([8] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "width", "counts"])


def token_frequencies(rows: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Documents per slot of hashed tokens, over all rows; 2**TABLE_BITS numbers."""
    schema = "part int, width int, counts binary"
    table = np.zeros((TABLE_PARTS, (1 << TABLE_BITS) // TABLE_PARTS), np.int64)
    parts = rows.select("text").mapInArrow(_frequency_parts(shingle), schema).repartition("part").mapInArrow(_sum_parts, schema)
    for r in parts.collect():
        table[r["part"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return table.ravel()


# kind 0: a row of the input (row, doc_id, n, rep); kind 1: a node (row, n, bitmap); kind 2: a signature (sig, row, n, weight)
SIGNED = "kind int, row long, doc_id long, n int, rep long, sig long, weight int, bits binary"
_SIGNED_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _signed(counts, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = counts.value, WordHashes()
        load = table.mean()
        noise = load + 4 * np.sqrt(load)
        for batch in pieces(batches, "text"):
            rows, ids = batch.column(ROW).to_pylist(), batch.column("doc_id").to_pylist()
            first: dict[bytes, int] = {}
            sizes, reps, nodes, sigs = [], [], [], []
            for row, tokens in zip(rows, _batch_sets(batch, hashes, shingle), strict=True):
                sizes.append(len(tokens))
                if not len(tokens):
                    reps.append(row)
                    continue
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                reps.append(first.setdefault(key, row))
                if reps[-1] != row:
                    continue
                nodes.append((row, len(tokens), bitmap(tokens)))
                weight = int(min(table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].mean(), (1 << 31) - 1))
                sigs.append((signatures(tokens, table, noise), row, len(tokens), weight))
            yield _signed_batch(0, len(rows), {1: rows, 2: ids, 3: sizes, 4: reps})
            yield _signed_batch(1, len(nodes), {1: [x[0] for x in nodes], 3: [x[1] for x in nodes], 7: [x[2] for x in nodes]})
            if sigs:
                each = [len(x[0]) for x in sigs]
                spread = {i: np.repeat(np.array([x[j] for x in sigs]), each) for i, j in ((1, 1), (3, 2), (6, 3))}
                yield _signed_batch(2, sum(each), {5: np.concatenate([x[0] for x in sigs]).view(np.int64), **spread})

    return run


def _signed_batch(kind: int, size: int, columns: dict) -> pa.RecordBatch:
    arrays = [pa.array(np.full(size, kind, np.int32))]
    arrays += [pa.array(columns[i], t) if i in columns else pa.nulls(size, t) for i, t in list(enumerate(_SIGNED_KINDS))[1:]]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SIGNED.split(", ")])


def _sized(n, m):
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_link(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)]
        yield batch.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, shared) whose sizes and bitmaps allow a link."""
    side = lambda c: nodes.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_sized(F.col("n_a"), F.col("n_b"))).mapInArrow(_bounded, "a long, b long, shared long")


def _sets_of(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            sets = [x.tobytes() for x in _batch_sets(batch, hashes, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(sets, pa.binary())], names=["row", "tokens"])

    return rows.select(ROW, "text").join(wanted.select(F.col("row").alias(ROW)), ROW, "left_semi").mapInArrow(run, "row long, tokens binary")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b")), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(linked(overlap(a, b), len(a), len(b)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("row").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified, "a long, b long")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component yet."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select(*pairs.columns)


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of plans that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def labelled(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: its row, doc_id, n (shingles) and label (a row of the component)."""
    spark = docs.sparkSession
    staged = Staged(spark)
    rows = source_rows(staged, docs, "doc_id", "text").select(ROW, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = spark.sparkContext.broadcast(token_frequencies(rows, shingle))
    signed = rows.mapInArrow(_signed(counts, shingle), SIGNED)
    # One pass over the texts writes inputs and nodes as they come; signatures pass their window first.
    keyed = signed.select("*", F.when(F.col("kind") == 2, F.col("sig")).otherwise(F.xxhash64("row", "kind")).alias("key"))
    same = Window.partitionBy("key", "kind")
    ranked = keyed.select(
        "kind", "row", "doc_id", "n", "rep", "sig", "bits", F.count(F.lit(1)).over(same).alias("members"), F.first("row").over(same.orderBy(F.desc("weight"), "row")).alias("pivot")
    ).where("kind < 2 or members > 1")
    passed = staged.put(ranked)
    _release(spark)
    inputs = passed.where("kind = 0").select("row", "doc_id", "n", "rep")
    nodes = passed.where("kind = 1").select("row", "n", "bits")
    buckets = passed.where("kind = 2").select("sig", "row", "n", "members", "pivot")

    met = buckets.where("row <> pivot").groupBy(F.col("pivot").alias("a"), F.col("row").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    starred = staged.put(_possible(met, nodes))
    ends = starred.select(F.col("a").alias("row")).unionByName(starred.select(F.col("b").alias("row"))).distinct()
    sets = staged.put(_sets_of(rows, staged.put(ends), shingle))
    _release(spark)
    # First every node with the pivot it shares most with, then what is still apart.
    best = starred.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    links = staged.put(_links(best, sets))
    labels = staged.put(components(staged, links))
    more = staged.put(_links(_across(starred, labels), sets))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = staged.put(components(staged, links))

    rest = staged.put(_remaining(staged, buckets, labels, nodes))
    if not rest.isEmpty():
        ends = staged.put(rest.select(F.col("a").alias("row")).unionByName(rest.select(F.col("b").alias("row"))).distinct().join(sets.select("row"), "row", "left_anti"))
        sets = sets.unionByName(staged.put(_sets_of(rows, ends, shingle)))
        found = staged.put(_links(rest, sets))
        if not found.isEmpty():
            labels = staged.put(components(staged, links.unionByName(found)))
    _release(spark)

    return inputs.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("row", "doc_id", "n", F.coalesce("label", "rep").alias("label"))


BLOCK = 512


def _remaining(staged: Staged, buckets: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Possible pairs (a, b) within a bucket and across components that no pivot has tested.

    Any such pair has an end outside the bucket's largest component. So the members of all buckets
    with one largest component form a neighbourhood, in which those outside it (the loose ones) are
    compared with all.
    """
    named = buckets.where("members > 2 and row <> pivot").join(labels.select(F.col("node").alias("row"), "label"), "row", "left").select("sig", "row", F.coalesce("label", "row").alias("label"))
    groups = named.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = groups.groupBy("sig").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("sig", "largest")
    near = named.join(largest, "sig").groupBy("largest", "row", "label").agg(F.lit(1).alias("one")).drop("one")
    near = staged.put(near.join(nodes, "row").select("largest", "row", "label", "n", "bits", (F.col("label") != F.col("largest")).alias("loose"), F.length("bits").alias("width")))
    sizes = near.groupBy("largest", "loose", "width").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = near.join(sizes, ["largest", "loose", "width"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    key = ["largest", "loose", "width", "block"]
    packed = staged.put(dealt.groupBy(*key).agg(F.collect_list(F.struct("row", "label", "n", "bits")).alias("held")))
    side = lambda c: packed.select(*(F.col(k).alias(f"{k}_{c}") for k in key))
    a, b = side("a").where("loose_a"), side("b")
    again = F.col("loose_b") & (F.struct("width_b", "block_b") < F.struct("width_a", "block_a"))
    widths = (F.greatest("width_a", "width_b") <= 2 * F.least("width_a", "width_b"))
    met = a.join(b, (F.col("largest_a") == F.col("largest_b")) & widths & ~again)
    for c in ("a", "b"):
        met = met.join(packed.select(*(F.col(k).alias(f"{k}_{c}") for k in key), F.col("held").alias(f"held_{c}")), [f"{k}_{c}" for k in key])
    return met.select("held_a", "held_b").mapInArrow(_compare_blocks, "a long, b long").distinct()


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (_unpacked(batch.column(c)[i].values) for c in ("held_a", "held_b"))
            width = min(left[3].shape[1], right[3].shape[1])
            x, y = _folded(left[3], width), _folded(right[3], width)
            for row, label, n, bits in zip(*left[:3], x, strict=True):
                apart = np.bitwise_count(y ^ bits).sum(1, dtype=np.int64)
                most = (n + right[2] - apart) // 2
                hit = (100 * most >= SIMILAR * (n + right[2] - most)) & (right[1] != label)
                if hit.any():
                    other = right[0][hit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, row)), pa.array(np.maximum(other, row))], names=["a", "b"])


def _unpacked(held: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, label, n = (np.asarray(held.field(c)).astype(np.int64) for c in ("row", "label", "n"))
    bits = np.frombuffer(b"".join(held.field("bits").to_pylist()), np.uint8).reshape(len(row), -1)
    return row, label, n, bits


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return np.ascontiguousarray(bits).view(np.uint64)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document. Cases: see the module's."""
    placed = labelled(docs, shingle)
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, but of each component only the one with the smallest doc_id (null last), then row."""
    staged = Staged(docs.sparkSession)
    docs, back = set_aside(docs)
    rows = source_rows(staged, docs, *docs.columns)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = staged.put(labelled(rows.drop(ROW), shingle).groupBy("label").agg(first.alias("first")).select(F.col("first.row").alias(ROW)))
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW).withColumnsRenamed(back)  # a row for most texts: never broadcast
