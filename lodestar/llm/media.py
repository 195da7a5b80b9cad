"""Media columns: texts as 8-bit PNG samples in a binary column, with checked chunks and cosine hashes.

Encoding: the UTF-8 payload, padded with zero bytes to a positive multiple of 64, becomes a grey
image 64 samples wide. Each row takes the filter whose differences, read as signed bytes, have the
smallest sum of magnitudes; of equal sums the first filter. Decoding walks the chunks, tests every
CRC-32 and the zlib checksum, and undoes the row filters in numpy, along the diagonals of many images
at once: a sample needs those to its left and above, which lie on the two diagonals before. The feature is the sign pattern of the 8 x 8 lowest cosine
coefficients of the image, averaged down to 32 x 32.

Cases: null and empty texts give one row of 64 zero samples; texts of any length are stored whole;
repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import binary_column, pieces

WIDTH = 64
GRID = 32
LOW = 8
IDAT_BYTES = 1 << 16
LEVEL = 6
PILES = 32
PIECE = 2 << 20
# Fixed values of the PNG format: its signature, and the filter numbers None, Sub, Up, Average, Paeth.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """The stored bytes aren't the image that was written."""


def pad_payload(data: bytes) -> bytes:
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return data.ljust(size, b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predictions(rows: np.ndarray, above: np.ndarray) -> Iterator[np.ndarray]:
    """What each filter predicts of rows that are known, in the order of the filters' numbers."""
    left, corner = (np.pad(x[:, :-1], ((0, 0), (1, 0))).astype(np.int16) for x in (rows, above))
    up = above.astype(np.int16)
    yield np.zeros_like(up)
    yield left
    yield up
    yield (left + up) >> 1
    yield _paeth(left, up, corner)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The one of the three that is nearest to left + up - corner, ties in that order."""
    by_left, by_up = np.abs(up - corner), np.abs(left - corner)
    by_corner = np.abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def filtered(rows: np.ndarray, row_filter: int | None = None) -> np.ndarray:
    """Rows with the number of their filter before them. row_filter: one filter for all rows, instead of the best of each."""
    above = np.vstack([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    best = np.full(len(rows), np.iinfo(np.int64).max)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for kind, guess in enumerate(_predictions(rows, above)):
        if row_filter not in (None, kind):
            continue
        apart = (rows - guess).astype(np.uint8)
        cost = np.abs(apart.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
        take = cost < best
        best[take] = cost[take]
        lines[take, 0] = kind
        lines[take, 1:] = apart[take]
    return lines


def encode_png(payload: bytes, row_filter: int | None = None) -> bytes:
    """A grey 8-bit PNG."""
    lines = filtered(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), row_filter)
    packed = zlib.compress(lines.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _chunks(media: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, view = 8, memoryview(media)
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("cut chunk")
        size = int.from_bytes(view[at : at + 4], "big")
        end = at + 8 + size
        if end + 4 > len(media) or zlib.crc32(view[at + 4 : end]) != int.from_bytes(view[end : end + 4], "big"):
            raise MediaError("chunk checksum differs")
        yield bytes(view[at + 4 : at + 8]), view[at + 8 : end]
        at = end + 4


def unfilter_all(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of one-byte pixels from filtered rows of equal width, many images at once.

    The images are dealt to piles of about equal height. Sample x of row r of a pile lies on its
    diagonal r + x; all piles advance by one diagonal at a time.
    """
    if not images:
        return []
    width, heights = images[0].shape[1] - 1, [len(i) for i in images]
    most = max(max(heights), -(-sum(heights) // PILES))
    place, pile, at = [], 0, 0
    for height in heights:
        if at + height > most:
            pile, at = pile + 1, 0
        place.append((pile, at))
        at += height
    shape = (most + width - 1, pile + 1, width)
    kinds, values, inner = np.zeros(shape, np.int8), np.zeros(shape, np.int16), np.zeros(shape, np.int16)
    across = np.arange(width)
    where = []
    for lines, (pile, at) in zip(images, place, strict=True):
        if lines[:, 0].max(initial=0) > PAETH:
            raise MediaError("unknown row filter")
        down = at + np.arange(len(lines))[:, None] + across
        kinds[down, pile, across], values[down, pile, across] = lines[:, :1], lines[:, 1:]
        inner[down[1:], pile, across] = 1  # has a row above in its image
        where.append((down, pile))
    left, corner = np.zeros((2, shape[1], width), np.int16)
    before, two_before = np.zeros((2, shape[1], width), np.int16)
    for d in range(len(values)):
        kind, here = kinds[d], inner[d]
        left[:, 1:] = before[:, :-1]
        corner[:, 1:] = two_before[:, :-1]
        up, edge = before * here, corner * here
        guess = np.choose(kind, (0, left, up, (left + up) >> 1, _paeth(left, up, edge)))
        values[d] = (values[d] + guess) & 255
        before, two_before = values[d], before
    return [values[down, pile, across].astype(np.uint8) for down, pile in where]


def read_png(media: bytes) -> np.ndarray:
    """The filtered rows, each behind its filter's number; raises MediaError where a checksum or a size is wrong."""
    inflate, parts, shape, ended = zlib.decompressobj(), [], None, False
    try:
        for kind, body in _chunks(media):
            if kind == b"IHDR":
                width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
                if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                    raise MediaError("not a plain grey 8-bit image")
                shape = (height, width)
            elif kind == b"IDAT":
                parts.append(inflate.decompress(body))
            elif kind == b"IEND":
                ended = True
    except zlib.error as e:
        raise MediaError(str(e)) from e
    raw = np.frombuffer(b"".join(parts), np.uint8)
    if not ended or shape is None or not inflate.eof or raw.size != shape[0] * (shape[1] + 1):
        raise MediaError("image is incomplete")
    return raw.reshape(shape[0], shape[1] + 1)


def decode_png(media: bytes) -> np.ndarray:
    """The samples as rows of one byte each."""
    return unfilter_all([read_png(media)])[0]


def _area_means(image: np.ndarray, cells: int) -> np.ndarray:
    """Means over `cells` equal stretches of axis 0; stretches may begin and end within a sample."""
    sums = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    at = np.linspace(0, image.shape[0], cells + 1)
    low = np.minimum(at.astype(int), image.shape[0] - 1)
    edge = sums[low] + (at - low)[:, None] * (sums[low + 1] - sums[low])
    return np.diff(edge, axis=0) * (cells / image.shape[0])


_STEP = np.arange(GRID)
_COSINE = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * _STEP[None] + 1) / (2 * GRID))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest cosine coefficients lie above their median (first one apart)."""
    small = _area_means(_area_means(image, GRID).T, GRID).T
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document: the stored image (null unless keep_media) and what is read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows = []
            texts = binary_column(batch.column("text"))
            stored = [encode_png(pad_payload(data)) for data in texts]
            for data, media, image in zip(texts, stored, unfilter_all([read_png(m) for m in stored]), strict=True):
                payload = image.tobytes()
                rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image), media if keep_media else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
