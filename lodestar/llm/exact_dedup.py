"""Exact deduplication through an extendible-hash index on shared files.

1. Every map task normalises its texts (all ASCII white space deleted) and writes a digest of each row
   to the shared folder: its hash, its SHA-256 and its sizes. Bytes are compared only where two rows
   share a hash, so no other text travels.
2. The directory of those hashes starts with one bucket for all. While a bucket's postings may hold
   more than `capacity` bytes, it is split by one more bit of the hash; a split below the directory's
   depth only divides pointers, any other doubles the directory. The driver sees sums by hash prefix,
   refined where they are too large: some numbers for each bucket, that is for each `capacity` bytes.
3. Map tasks fold equal texts into postings, bytes compared, and send those of shared hashes to the
   owner of their bucket; a bitmap of fixed size tells them which. Owner tasks take one bucket each,
   chain the postings of a hash and compare bytes along the chain, so that texts whose hashes collide
   stay apart. A bucket of one hash can't be split by bits; if it is too large, several owners chain
   parts of it and a last one their chains, a few for each.
4. Each digest looks its chain up; rows without one stand alone.

Cases: null text counts as empty; empty texts are equal to each other; very long texts are compared
whole; ties in length go to the smallest doc_id, null last, then to the first row, so that of repeated
rows one stays; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ASCII_SPACE, ROW, Staged, binary_column, pieces, set_aside, source_rows, splitmix

CAPACITY = 32 << 20
PIECE = 8 << 20
BITMAP_BITS = 24
BITMAP_PARTS = 64
FIRST_BITS, MORE_BITS = 12, 8

DIGEST = "row long, doc_id long, size long, bytes long, hash long, sha binary"
POSTING = "owner int, ways int, hash long, sha binary, body binary, members long, best_size long, best_id long, best_row long"
OWNED = "hash long, sha binary, body binary, chain int, members long, best_size long, best_id long, best_row long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def better(a: tuple[int, int | None, int], b: tuple[int, int | None, int]) -> bool:
    """Whether (code points, doc_id, row) a stays rather than b."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return a[1] is not None and (b[1] is None or a[1] < b[1])
    return a[2] < b[2]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [x.translate(None, ASCII_SPACE) for x in binary_column(batch.column("text"))]


def _digests(hash_bits: int):
    mask = (1 << hash_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_pylist()
            bodies = _bodies(batch)
            keys = [_signed(xxhash.xxh3_64_intdigest(b) & mask) for b in bodies]
            yield _batch(DIGEST, [batch.column(ROW).to_pylist(), batch.column("doc_id").to_pylist(), sizes, list(map(len, bodies)), keys, [hashlib.sha256(b).digest() for b in bodies]])

    return run


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bitmap_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        seen[_slots(np.asarray(batch.column("hash")))] = True
    parts = np.packbits(seen).reshape(BITMAP_PARTS, -1)
    held = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[i].tobytes() for i in held], pa.binary())], names=["part", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(bits, np.uint8)
            parts[part] = parts[part] | own if part in parts else own
    yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])


def shared_slots(hashes: DataFrame) -> np.ndarray:
    """The bitmap of 2**BITMAP_BITS slots that hashes fall into, packed."""
    schema, out = "part int, bits binary", np.zeros((BITMAP_PARTS, (1 << BITMAP_BITS) // 8 // BITMAP_PARTS), np.uint8)
    for r in hashes.select("hash").mapInArrow(_bitmap_parts, schema).repartition("part").mapInArrow(_united, schema).collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _postings(hash_bits: int, shared, directory):
    mask = (1 << hash_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, owners = shared.value, directory.value
        for batch in pieces(batches, "text", PIECE):
            bodies = _bodies(batch)
            keys = np.array([xxhash.xxh3_64_intdigest(b) & mask for b in bodies], np.uint64)
            slots = _slots(keys)
            asked = np.flatnonzero(bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
            if not len(asked):
                continue
            picked = batch.take(pa.array(asked))
            sizes = pa.compute.fill_null(pa.compute.utf8_length(picked.column("text")), 0).to_pylist()
            first: dict[bytes, list] = {}
            for at, size, doc, row in zip(asked.tolist(), sizes, picked.column("doc_id").to_pylist(), picked.column(ROW).to_pylist(), strict=True):
                entry = first.setdefault(bodies[at], [at, 0, size, doc, row])
                entry[1] += 1
                if better((size, doc, row), tuple(entry[2:])):
                    entry[2:] = [size, doc, row]
            held = list(first.items())
            own = keys[[e[0] for _, e in held]]
            owner, ways = owners.find(own, np.array([e[4] for _, e in held]))
            yield _batch(POSTING, [owner, ways, own.view(np.int64), [hashlib.sha256(b).digest() for b, _ in held], [b for b, _ in held], *([e[i] for _, e in held] for i in (1, 2, 3, 4))])

    return run


class Directory:
    """Buckets of hash prefixes, split while they are over capacity.

    cells: (first hash, bits, bytes, whether it is one hash) of hash prefixes; none is split further.
    depth is the directory's: the most bits that tell two buckets apart.
    """

    def __init__(self, cells: list[tuple[int, int, int, bool]], capacity: int) -> None:
        cells = sorted(cells)
        at = [c[0] for c in cells]
        total = [0, *np.cumsum([c[2] for c in cells], dtype=object)] if cells else [0]
        self.depth = 0
        pending, done = [(0, 0, 0, len(cells))], []  # prefix, bits, cells from, to
        while pending:
            prefix, local, low, high = pending.pop()
            if total[high] - total[low] <= capacity or high - low == 1 and (cells[low][3] or cells[low][1] <= local):
                done.append((prefix << (64 - local), total[high] - total[low], high - low == 1 and cells[low][3]))
                continue
            if local == self.depth:
                self.depth += 1  # the directory doubles
            middle = low + int(np.searchsorted(np.array(at[low:high], np.uint64), np.uint64((2 * prefix + 1) << (63 - local)), side="left"))
            pending += [(2 * prefix, local + 1, low, middle), (2 * prefix + 1, local + 1, middle, high)]
        done.sort()
        self.starts = np.array([d[0] for d in done], np.uint64)
        self.ways = np.array([-(-d[1] // capacity) if d[2] else 1 for d in done], np.int64)
        self.ways = np.maximum(self.ways, 1)
        self.first = np.cumsum(self.ways) - self.ways

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, owners of the bucket) of each posting; rows deal out the postings of a bucket with several."""
        bucket = np.searchsorted(self.starts, hashes, side="right") - 1
        ways = self.ways[bucket]
        return (self.first[bucket] + (splitmix(rows) % ways.astype(np.uint64)).astype(np.int64)).astype(np.int32), ways.astype(np.int32)

    def __len__(self) -> int:
        return int(self.ways.sum())


def index(shared: DataFrame, pieces_in_all: int, capacity: int) -> Directory:
    """The directory of hashes (hash, n, bytes) by the postings that can come of them: one from each piece at most."""
    weight = F.col("bytes") * F.least(F.col("n"), F.lit(pieces_in_all)) + 64
    bits, cells, scope = FIRST_BITS, [], shared
    while True:
        prefix = F.expr(f"shiftrightunsigned(hash, {64 - bits})").alias("prefix")
        sums = scope.groupBy(prefix).agg(F.sum(weight).alias("bytes"), (F.min("hash") == F.max("hash")).alias("one")).toPandas()
        over = (sums["bytes"] > capacity) & ~sums["one"] if bits < 60 else sums["bytes"] < 0
        cells += [(int(p) << (64 - bits), bits, int(b), bool(o)) for p, b, o in sums[~over].itertuples(index=False)]
        if not over.any():
            return Directory(cells, capacity)
        wanted = shared.sparkSession.createDataFrame(sums.loc[over, ["prefix"]])  # a number for each bucket that is too large
        scope = scope.join(wanted, prefix == wanted["prefix"], "left_semi")
        bits += MORE_BITS


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings come sorted by hash; only the chain of the hash at hand is in memory. Parts of a hash keep their bytes."""
    at, ways, chain, rows = None, 1, [], []

    def end() -> None:
        rows.extend((at, x[1], x[0] if ways > 1 else None, i, *x[2:]) for i, x in enumerate(chain))

    for batch in pieces(batches, "body", PIECE):
        for key, parts, sha, body, members, *best in zip(*(batch.column(c).to_pylist() for c in ("hash", "ways", "sha", "body", "members", "best_size", "best_id", "best_row")), strict=True):
            if key != at:
                end()
                at, ways, chain = key, parts, []
            link = next((x for x in chain if x[0] == body), None)
            if link is None:
                chain.append([body, sha, members, *best])
                continue
            link[2] += members
            if better(tuple(best), tuple(link[3:])):
                link[3:] = best
        yield _batch(OWNED, list(zip(*rows, strict=True)) or [()] * 8)
        rows.clear()
    end()
    yield _batch(OWNED, list(zip(*rows, strict=True)) or [()] * 8)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per document: its row, doc_id, size (code points), keep_id, group_size, kept, text_sha256, chain.

    capacity: bytes of a bucket's postings. hash_bits below 64 provokes collisions, for tests.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    rows = source_rows(staged, docs, "doc_id", "text").select(ROW, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    digests = staged.put(rows.mapInArrow(_digests(hash_bits), DIGEST))
    total = digests.agg(F.sum("bytes")).first()[0] or 0
    shared = staged.put(digests.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).where("n > 1"))
    directory = index(shared, total // PIECE + 1_000, capacity)
    send = spark.sparkContext.broadcast
    postings = rows.mapInArrow(_postings(hash_bits, send(shared_slots(shared)), send(directory)), POSTING)
    owned = staged.put(postings.repartitionById(len(directory), "owner").sortWithinPartitions("hash").mapInArrow(_own, OWNED))
    parts = owned.where("body is not null").select(F.lit(1).alias("ways"), "hash", "sha", "body", "members", "best_size", "best_id", "best_row")
    groups = owned.where("body is null").unionByName(parts.repartition("hash").sortWithinPartitions("hash").mapInArrow(_own, OWNED)).drop("body")
    alone = F.col("members").isNull()
    return digests.join(groups, ["hash", "sha"], "left").select(
        F.col("row").alias(ROW),
        "doc_id",
        "size",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.coalesce("chain", F.lit(0)).alias("chain"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, whatever they are called. Cases: see the module's."""
    staged = Staged(docs.sparkSession)
    docs, back = set_aside(docs)
    rows = source_rows(staged, docs, *docs.columns)
    kept = staged.put(exact_groups(rows.drop(ROW)).where("kept").select(ROW))
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW).withColumnsRenamed(back)  # a row for most texts: never broadcast
