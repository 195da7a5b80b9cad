"""Indel ratios of many pairs of strings at once, with numpy.

A string's signature counts its characters in 32 bins, up to two in each. The bits in which two signatures differ are
never more than the Indel distance of the strings, so they leave few pairs to the exact longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np

from lodestar.functions.text import indel

BINS, WORD, TILE = 32, 64, 1 << 20


class Strings:
    """Code points, lengths and signatures of strings."""

    def __init__(self, values: Sequence[str]) -> None:
        self.values = values
        self.size = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(values), dtype=np.int64), self.size)
        count = np.bincount(row * BINS + self.codes % BINS, minlength=len(values) * BINS).reshape(-1, BINS)
        shift = np.arange(BINS, dtype=np.uint64)
        held = lambda n: ((count >= n).astype(np.uint64) << shift).sum(1, dtype=np.uint64)
        self.signature = held(1) | held(2) << np.uint64(BINS)

    @cached_property
    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """The different characters, and for each string and character the places among the first WORD; the last column is empty."""
        known, code = np.unique(np.append(self.codes, np.uint32(0)), return_inverse=True)
        masks = np.zeros((len(self.values), len(known) + 1), np.uint64)
        row = np.repeat(np.arange(len(self.values)), self.size)
        place = np.arange(len(row)) - self.start[row]
        fits = place < WORD
        np.bitwise_or.at(masks, (row[fits], code[:-1][fits]), np.uint64(1) << place[fits].astype(np.uint64))
        return known, masks


def candidates(a: Strings, b: Strings, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs that may reach the ratio `least`, in pieces of some TILE pairs."""
    held, size = [], 0
    for piece in _pieces(a, b, least):
        held.append(piece)
        size += len(piece[0])
        if size >= TILE:
            yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])
            held, size = [], 0
    if size:
        yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])


def _pieces(a: Strings, b: Strings, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(a.size, kind="stable")
    ends = np.flatnonzero(np.diff(a.size[order], append=-1)) + 1
    for start, end in zip([0, *ends[:-1]][: len(ends)], ends, strict=True):
        n = a.size[order[start]]
        most = np.floor((n + b.size) * (100 - least) / 100 + 1e-6).astype(np.int64)
        other = np.flatnonzero(np.abs(b.size - n) <= most)
        if not len(other):
            continue
        most, signature = np.minimum(most[other], WORD).astype(np.uint8), b.signature[other]
        step = max(1, TILE // len(other))
        for k in range(start, end, step):
            some = order[k : min(k + step, end)]
            i, j = np.nonzero(np.bitwise_count(a.signature[some][:, None] ^ signature) <= most)
            yield some[i], other[j]


def ratios(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The ratios of the pairs (a[i], b[j]), as text.indel has them; empty strings are equal."""
    out = np.full(len(i), 100.0)
    total = a.size[i] + b.size[j]
    short = (b.size[j] <= WORD) & (a.size[i] <= 4 * WORD) & (total > 0)
    for k in np.flatnonzero(~short & (total > 0)):
        out[k] = indel(a.values[i[k]], b.values[j[k]])
    known, masks = b.masks
    at = np.searchsorted(known, a.codes)
    at[known[np.minimum(at, len(known) - 1)] != a.codes] = len(known)
    todo = np.flatnonzero(short)
    for k in range(0, len(todo), TILE):
        pairs = todo[k : k + TILE]
        pairs = pairs[np.argsort(-a.size[i[pairs]], kind="stable")]
        x, y = i[pairs], j[pairs]
        size, start = a.size[x], a.start[x]
        state = np.full(len(pairs), ~np.uint64(0))
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t))  # the strings longer than t come first
            s = state[:n]
            u = s & masks[y[:n], at[start[:n] + t]]
            state[:n] = (s + u) | (s - u)
        width = b.size[y].astype(np.uint64)
        full = np.where(width > 0, ~np.uint64(0) >> (np.uint64(WORD) - np.maximum(width, np.uint64(1))), np.uint64(0))
        common = b.size[y] - np.bitwise_count(state & full)
        out[pairs] = 200.0 * common / total[pairs]
    return out
