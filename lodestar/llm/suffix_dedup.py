"""Repeated strings of bytes, by a hash-compared suffix sort of anchored suffixes.

A byte goes where a string of LENGTH bytes covers it that also starts earlier in the corpus (in a
smaller doc_id, or earlier in the same document). Not every suffix is sorted: of each LENGTH-byte
window, the K-byte string with the smallest hash is its anchor, so equal windows have equal anchors
at equal offsets, and all windows around an anchor are decided at the anchor.

1. Each task finds its anchors with rolling prefix hashes. Owner tasks take ranges of anchor hashes
   and find those that occur twice; a bitmap of bounded size tells the next pass which they may be.
2. Each task finds its anchors again. Those with equal surroundings (all bytes that windows with this
   anchor can reach) within a batch are compared byte by byte; all but the first are covered as a whole.
   First ones whose hash occurs elsewhere send their surroundings to the owner of the hash.
3. The owner compares equal surroundings byte by byte in the same way. Anchors that differ further out
   go into the suffix sort: a mergesort whose comparisons find the common extension by binary search
   over prefix polynomial hashes, once to the right and once to the left (reversed). The sorted
   neighbours' common extensions are then taken from the bytes themselves; where the order contradicts
   them (a hash collision), the suffixes are sorted anew by their bytes. Windows are equal where both
   extensions reach, and of equal windows the first stays. No byte goes by a hash alone.
4. Covered stretches go back to their documents.

Cases: null counts as empty; texts shorter than LENGTH lose nothing; very long texts are read in
overlapping segments, whole; rows that share a doc_id are ordered by row, null doc_ids come last;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ROW, Staged, binary_column, pieces, source_rows, splitmix

LENGTH = 100
K = 32
REACH = LENGTH - K  # how far left of its anchor a window can start
SEGMENT = 1 << 20
PART_BYTES = 16 << 20
SORTED_AT_ONCE = 20_000
COMPARED_AT_ONCE = 20_000
PIECE = 32 << 20
BITMAP_PARTS = 64
LEAST_BITS, MOST_BITS = 22, 28  # the bitmap has 32 MB at most; when it is full, all anchors send their surroundings
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the base of the polynomial hashes, and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (self._table(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[: n + 1], self.down[: n + 1]


_powers = Powers()


def _sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, hashes of the surroundings) of the anchors in documents laid end to end."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 2)
    up, down = _powers.upto(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    grams = splitmix((sums[K:] - sums[:-K]) * down[: n - K + 1])
    owner_end = np.repeat(ends, ends - starts)
    at = np.arange(n)
    grams[at[: n - K + 1] + K > owner_end[: n - K + 1]] = np.iinfo(np.uint64).max
    low = _sliding(grams, REACH + 1, np.minimum)
    low[at[: n - LENGTH + 1] + LENGTH > owner_end[: n - LENGTH + 1]] = 0
    pad = np.zeros(REACH, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), REACH + 1, np.maximum)
    found = np.flatnonzero((high == grams) & (high != 0))
    first = np.maximum(found - REACH, np.repeat(starts, ends - starts)[found])
    last = np.minimum(found + LENGTH, owner_end[found])
    around = splitmix(splitmix((sums[last] - sums[first]) * down[first]) + (((found - first) << 8) | (last - found)).astype(np.uint64))
    return found, grams[found], around


def text_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, position, hash, surroundings) of all anchors; long texts go in overlapping segments."""
    out: list[tuple] = []
    margin = LENGTH + REACH

    def whole(group: list[int]) -> None:
        sizes = np.array([len(texts[i]) for i in group], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found, grams, around = anchors(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), starts, ends)
        owner = np.searchsorted(ends, found, side="right")
        out.append((np.array(group, np.int64)[owner], found - starts[owner], grams, around))

    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > SEGMENT:
            for start in range(0, len(text), SEGMENT):
                first = max(0, start - margin)
                part = np.frombuffer(text[first : start + SEGMENT + margin], np.uint8)
                found, grams, around = anchors(part, np.array([0]), np.array([len(part)]))
                mine = (found + first >= start) & (found + first < start + SEGMENT)
                out.append((np.full(mine.sum(), i, np.int64), found[mine] + first, grams[mine], around[mine]))
            continue
        if size + len(text) > SEGMENT:
            whole(group)
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        whole(group)
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each element of sorted columns begins a new run."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _stretches(new: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run."""
    edges = [*np.flatnonzero(new).tolist(), len(new)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def batch_anchors(batch: pa.RecordBatch, around_bits: int = 64) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The batch's texts and its anchors, those with equal hash and hash of surroundings together, in corpus order."""
    ids = np.array([LAST if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
    texts = binary_column(batch.column("text"))
    number, pos, hashes, around = text_anchors(texts)
    around = around & np.uint64((1 << around_bits) - 1)
    row = np.asarray(batch.column(ROW))[number]
    order = np.lexsort((pos, row, ids[number], around, hashes))
    found = {"number": number, "pos": pos, "hash": hashes, "around": around, "doc": ids[number], "row": row}
    return texts, {k: v[order] for k, v in found.items()}


def _by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for a, b in _stretches(_runs(part[order])):
        yield int(part[order[a]]), order[a:b]


def _map_hashes(parts: int, around_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            _, found = batch_anchors(batch, around_bits)
            hashes, times = np.unique(found["hash"][_runs(found["hash"], found["around"])], return_counts=True)
            hashes = np.repeat(hashes, np.minimum(times, 2))
            rows = [(part, hashes[own].tobytes()) for part, own in _by_part(hashes, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "bits"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each part; they come sorted by part."""
    at, held = None, []
    for batch in batches:
        for part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != at and held:
                yield held
                held = []
            at = part
            held.append(tuple(rest))
    if held:
        yield held


def _own_hashes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits - 3, np.uint8)
        for held in _parts(batches):
            hashes = np.sort(np.concatenate([np.frombuffer(h, np.uint64) for (h,) in held]))
            slots = _slots(hashes[1:][hashes[1:] == hashes[:-1]], bits)
            np.bitwise_or.at(seen, slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
        packed = seen.reshape(BITMAP_PARTS, -1)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(bits, np.uint8)
            parts[part] = parts[part] | own if part in parts else own
    yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def shared_slots(rows: DataFrame, parts: int, bits: int, around_bits: int = 64) -> np.ndarray:
    """The bitmap of 2**bits slots that anchors which occur twice fall into, packed."""
    schema, out = "part int, bits binary", np.zeros((BITMAP_PARTS, (1 << bits) // 8 // BITMAP_PARTS), np.uint8)
    owned = rows.mapInArrow(_map_hashes(parts, around_bits), schema).repartition("part").sortWithinPartitions("part").mapInArrow(_own_hashes(bits), schema)
    for r in owned.repartition("part").mapInArrow(_united, schema).collect():  # BITMAP_PARTS rows, 2**bits bits together
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all stretches of bytes as long as surroundings, where each text starts among them, sizes of the texts)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join([bytes(REACH), *texts, bytes(LENGTH)]), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, _CONTEXT), np.cumsum(sizes) - sizes, sizes


def surroundings(laid: tuple[np.ndarray, np.ndarray, np.ndarray], number: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes around each anchor, zero beyond the text; how many of them lie left and right of its start)."""
    stretches, starts, sizes = laid
    view = stretches[starts[number] + pos]
    reach = np.column_stack([np.minimum(pos, REACH), np.minimum(sizes[number] - pos, LENGTH)]).astype(np.uint8)
    at = np.arange(_CONTEXT)
    return np.where((at >= REACH - reach[:, :1]) & (at < REACH + reach[:, 1:].astype(np.int64)), view, 0), reach


def again(hashes: np.ndarray, around: np.ndarray, context) -> np.ndarray:
    """Whether the surroundings of each anchor are, byte by byte, those of the one before it. context(i) gives bytes and reach."""
    same = ~_runs(hashes, around)
    asked = np.flatnonzero(same)
    for start in range(0, len(asked), COMPARED_AT_ONCE):
        own = asked[start : start + COMPARED_AT_ONCE]
        (a, left), (b, right) = context(own - 1), context(own)
        same[own] = (a == b).all(1) & (left == right).all(1)
    return same


def _by_row(row: np.ndarray, pos: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order].astype(np.int32)
    runs = _stretches(_runs(row))
    return [int(row[a]) for a, _ in runs], [pos[a:b].tobytes() for a, b in runs]


# part < 0: positions of a document whose surroundings are covered as a whole; else the packed surroundings of a part
CONTEXTS = "part int, row long, hash binary, around binary, doc binary, rows binary, pos binary, reach binary, bytes binary"
MARKS = "row long, whole binary, spans binary"
_CONTEXT = REACH + LENGTH


def _map_contexts(parts: int, shared, bits: int, around_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, pack = shared.value, zstandard.ZstdCompressor(level=1).compress
        for batch in pieces(batches, "text", PIECE):
            texts, found = batch_anchors(batch, around_bits)
            laid = laid_out(texts)
            del texts
            same = again(found["hash"], found["around"], lambda i, t=laid, f=found: surroundings(t, f["number"][i], f["pos"][i]))
            rows = [(-1 - row % 1024, row, None, None, None, None, pos, None, None) for row, pos in zip(*_by_row(found["row"][same], found["pos"][same]), strict=True)]
            slot = _slots(found["hash"], bits)
            shared_here = np.zeros(len(same), bool)  # first ones of a hash that has several in this batch
            first = np.flatnonzero(~same)
            new = _runs(found["hash"][first])
            shared_here[first] = ~(new & np.append(new[1:], True)) if len(new) else new
            asked = np.flatnonzero(~same & (shared_here | ((slots[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1) == 1)))
            for part, own in _by_part(found["hash"][asked], parts):
                own = asked[own]
                view, reach = surroundings(laid, found["number"][own], found["pos"][own])
                rows.append((part, None, *(found[k][own].tobytes() for k in ("hash", "around", "doc", "row", "pos")), reach.tobytes(), pack(view.tobytes())))
                if sum(len(r[8] or b"") for r in rows[-64:]) > PIECE:
                    yield _context_batch(rows)
                    rows = []
            yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in CONTEXTS.split(", ")])


def _mark_batch(rows: list[int], whole: list[bytes | None], spans: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(whole, pa.binary()), pa.array(spans, pa.binary())], names=[f.split()[0] for f in MARKS.split(", ")])


class Suffixes:
    """Strings of bounded length with prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.data, self.sizes = data, sizes.astype(np.int64)
        n, width = data.shape
        self.prefix = np.zeros((n, width + 1), np.uint64)
        base = np.uint64(_BASE)
        for i in range(width):
            self.prefix[:, i + 1] = self.prefix[:, i] * base + _BYTE[data[:, i]]
        self.steps = width.bit_length()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common extensions by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair; a string comes before its extensions."""
        n = self.common(a, b)
        ends = (n >= self.sizes[a]).astype(np.int64) - (n >= self.sizes[b]).astype(np.int64)
        at = np.minimum(n, self.data.shape[1] - 1)
        return np.where(ends != 0, -ends, np.where(n >= self.sizes[a], 0, np.sign(self.data[a, at].astype(np.int64) - self.data[b, at])))

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension of each string with the one before it), verified on the bytes."""
        n = len(self.sizes)
        order, run = np.arange(n), 1
        slot = np.arange(n)
        while run < n:
            pair = slot // (2 * run)
            second = slot // run % 2 == 1
            other = np.where(second, pair * 2 * run, np.minimum(pair * 2 * run + run, n))
            low, high = other.copy(), np.minimum(other + run, n)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                sign = self.compare(order[open_], order[mid])
                before = np.where(second[open_], sign >= 0, sign > 0)  # the other's element stays in front
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = np.empty_like(order)
            merged[pair * 2 * run + (slot - np.where(second, pair * 2 * run + run, pair * 2 * run)) + (low - other)] = order
            order, run = merged, 2 * run
        lengths, sound = self._verified(order)
        if not sound:
            order = np.array(sorted(range(n), key=lambda i: self.data[i, : self.sizes[i]].tobytes()), np.int64)
            lengths, _ = self._verified(order)
        return order, lengths

    def _verified(self, order: np.ndarray) -> tuple[np.ndarray, bool]:
        lengths = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return lengths, True
        a, b = self.data[order[:-1]], self.data[order[1:]]
        limit = np.minimum(self.sizes[order[:-1]], self.sizes[order[1:]])
        apart = a != b
        first = np.where(apart.any(1), apart.argmax(1), a.shape[1])
        lengths[1:] = np.minimum(first, limit)
        at = np.minimum(lengths[1:], a.shape[1] - 1)
        rows = np.arange(len(a))
        sound = np.where(lengths[1:] >= limit, self.sizes[order[:-1]] <= self.sizes[order[1:]], a[rows, at] < b[rows, at])
        return lengths, bool(sound.all())


def covered(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """By string and offset: whether the window that starts so far left of the anchor is that of an earlier string.

    Strings come in corpus order; left holds the bytes before the anchor, nearest first.
    """
    n = len(left)
    classes = []
    for data, sizes in ((right, right_sizes), (left, left_sizes)):
        order, common = Suffixes(data, sizes).sort()
        classes.append((order, common))
    out = np.zeros((n, REACH + 1), bool)
    ids = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for offset in range(REACH + 1):
        for i, need in ((0, LENGTH - offset), (1, offset)):
            order, common = classes[i]
            ids[i][order] = np.cumsum(common < need)
        valid = np.flatnonzero((left_sizes >= offset) & (right_sizes >= LENGTH - offset))
        key = ids[0][valid] * (n + 1) + ids[1][valid]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(valid), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        out[valid[again], offset] = True
    return out


def _settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The decisions about one part."""
    unpack = zstandard.ZstdDecompressor().decompress
    hashes, around = (np.concatenate([np.frombuffer(x[i], np.uint64) for x in held]) for i in (0, 1))
    doc, row, pos = (np.concatenate([np.frombuffer(x[i], np.int64) for x in held]) for i in (2, 3, 4))
    reach = np.concatenate([np.frombuffer(x[5], np.uint8).reshape(-1, 2) for x in held])
    data = np.concatenate([np.frombuffer(unpack(x[6]), np.uint8).reshape(-1, _CONTEXT) for x in held])
    order = np.lexsort((pos, row, doc, around, hashes))
    same = again(hashes[order], around[order], lambda i: (data[order[i]], reach[order[i]]))
    rows, packed = _by_row(row[order[same]], pos[order[same]])
    yield _mark_batch(rows, packed, [None] * len(rows))
    order = order[~same]
    new = _runs(hashes[order])
    order = order[~(new & np.append(new[1:], True))]  # the rest of their hash
    reach = reach.astype(np.int64)
    edges = np.append(np.flatnonzero(_runs(hashes[order])), len(order))
    start = 0
    while start < len(edges) - 1:  # whole groups of one hash, about SORTED_AT_ONCE strings together
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + SORTED_AT_ONCE, side="right")) - 1)
        own = order[edges[start] : edges[stop]]
        own = own[np.lexsort((pos[own], row[own], doc[own]))]
        hit = covered(data[own, REACH - 1 :: -1] if REACH else data[own, :0], reach[own, 0], data[own, REACH:], reach[own, 1])
        change = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(change == 1)
        _, high = np.nonzero(change == -1)
        owner = own[who]
        spans = np.column_stack([pos[owner] - (high - 1), pos[owner] - low + LENGTH]).astype(np.int32)
        by = np.argsort(row[owner], kind="stable")
        runs = _stretches(_runs(row[owner][by]))
        yield _mark_batch([int(row[owner][by[a]]) for a, _ in runs], [None] * len(runs), [spans[by[a:b]].tobytes() for a, b in runs])
        start = stop


def _own_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; one part is in memory at a time."""

    def packed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.compute.less(batch.column("part"), 0)
            some = batch.filter(marks)
            done.append(_mark_batch(some.column("row").to_pylist(), some.column("pos").to_pylist(), [None] * some.num_rows))
            yield batch.filter(pa.compute.invert(marks)).drop_columns(["row"])

    done: list[pa.RecordBatch] = []
    for held in _parts(packed()):
        yield from done
        done.clear()
        yield from _settle(held)
    yield from done


def removed_spans(size: int, whole: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Maximal covered stretches (start, end) of a document of `size` bytes."""
    starts = np.concatenate([np.maximum(whole - REACH, 0), spans[:, 0]])
    ends = np.concatenate([np.minimum(whole + LENGTH, size), spans[:, 1]])
    if not len(starts):
        return np.empty((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return np.column_stack([starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]]).astype(np.int64)


RESULT = f"{ROW} long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept binary"


def _cut_out(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for text, whole, spans in zip(binary_column(batch.column("text")), batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = removed_spans(len(text), np.frombuffer(b"".join(whole or ()), np.int32).astype(np.int64), np.frombuffer(b"".join(spans or ()), np.int32).astype(np.int64).reshape(-1, 2))
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest(), gone.astype(np.int64).tobytes(), kept if keep_bytes else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), *columns], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = True, around_bits: int = 64) -> DataFrame:
    """One row per document: sizes, the removed stretches (pairs of 64-bit numbers) and the bytes that stay (null unless keep_bytes).

    around_bits below 64 provokes collisions of surroundings, for tests.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    rows = source_rows(staged, docs, "doc_id", "text").select(ROW, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length() - 3))
    shared = spark.sparkContext.broadcast(shared_slots(rows, parts, bits, around_bits))
    _release(spark)
    marks = staged.put(rows.mapInArrow(_map_contexts(parts, shared, bits, around_bits), CONTEXTS).repartition("part").sortWithinPartitions("part").mapInArrow(_own_contexts, MARKS))
    _release(spark)
    hits = marks.groupBy(F.col("row").alias(ROW)).agg(F.collect_list("whole").alias("whole"), F.collect_list("spans").alias("spans"))
    return rows.join(hits, ROW, "left").select(ROW, "doc_id", "text", "whole", "spans").mapInArrow(_cut_out(keep_bytes), RESULT)


def _release(spark) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()
