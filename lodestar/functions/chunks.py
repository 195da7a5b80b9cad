"""Chunkers: cutting texts into overlapping pieces, as Arrow UDFs that yield arrays of structs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.types import TEXT, WHOLE, struct

BREAK = re.compile(r"[ \n]")
PIECES = T.ArrayType(struct(chunk_no=WHOLE, start=WHOLE, text=TEXT))


def cut(text: str | None, size: int, overlap: int, floor: float = 0.5) -> Iterator[tuple[int, str]]:
    """(start, piece): pieces of at most `size` that end at their last blank or line end past `floor` of it, if there is one.

    A paragraph's end, a line's and a sentence's all begin or end with such a place, so the furthest of them is one. The next
    piece begins `overlap` before. Without a size the text is one piece.
    """
    body = (text or "").strip()
    if size <= 0:
        yield from [(0, body)] if body else ()
        return
    back = min(max(0, overlap), size) if overlap < size else size // 5
    breaks = [m.start() for m in BREAK.finditer(body)]
    start, end = 0, 0
    while end < len(body):
        end = min(len(body), start + size)
        if end < len(body):
            last = bisect_left(breaks, end) - 1
            if last >= 0 and breaks[last] >= start + max(1, int(size * floor)):
                end = breaks[last]
        if piece := body[start:end].strip():
            yield start, piece
        start = max(start + 1, end - back)


def chunker(size: int, overlap: int, floor: float = 0.5, most: int | None = None) -> Callable[[Column], Column]:
    """A column function: text to an array of (chunk_no, start, text)."""

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_no": i, "start": s, "text": p} for i, (s, p) in enumerate(cut(t, size, overlap, floor)) if most is None or i < most])

    return pieces


search_chunks = chunker(1200, 200)
graph_chunks = chunker(3000, 0, floor=0.7)
page_chunks = chunker(2200, 300, most=40)


def adaptive_split(text: str, fits: Callable[[str], bool], smallest: int = 200) -> list[str]:
    """Halves a text at blanks until every piece fits or is as small as allowed."""
    todo, out = [text], []
    while todo:
        piece = todo.pop()
        if fits(piece) or len(piece) <= smallest:
            out.append(piece)
            continue
        middle = piece.rfind(" ", len(piece) // 4, len(piece) // 2 + 1)
        middle = middle if middle > 0 else len(piece) // 2
        todo += [piece[middle:].strip(), piece[:middle].strip()]
    return [p for p in out if p]
