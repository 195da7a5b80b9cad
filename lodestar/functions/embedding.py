"""Embedding with a model that may refuse a batch or a text: bisect the batch, then split the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestar.functions.chunks import BREAK

SCHEMA = "document_id string, chunk_no int, part int, text string, vector array<double>"
Model = Callable[[list[str]], list[list[float]]]


class TooLong(ValueError):
    """The model's context doesn't hold a text."""


def limited(most: int) -> Model:
    """A deterministic stand-in for a model: the length of each text; refuses batches with a text over `most` characters."""

    def embed(texts: list[str]) -> list[list[float]]:
        if max(map(len, texts)) > most:
            raise TooLong(most)
        return [[float(len(t)), 0.25] for t in texts]

    return embed


def split(text: str, overlap: int) -> list[str]:
    """A refused text in two parts, apart at the last blank or line end of its second quarter, else in the middle; none if it can't be split.

    The second part begins up to `overlap` before, but an eighth of the text at most, so that parts always get shorter.
    """
    half = len(text) // 2
    places = [m.start() for m in BREAK.finditer(text, half // 2, half + 1)]
    middle = places[-1] if places else half
    parts = (text[:middle].strip(), text[middle - min(max(0, overlap), half // 4) :].strip())
    return [p for p in parts if p and p != text] if half else []


def vectors(texts: list[str], embed: Model, overlap: int) -> Iterator[tuple[int, int, str, list[float]]]:
    """(number of the text, part, text, vector) of all texts, in order."""
    todo = [[(i, t) for i, t in enumerate(texts)]]
    parts = [0] * len(texts)
    while todo:
        batch = todo.pop()
        try:
            found = embed([t for _, t in batch])
        except TooLong:
            if len(batch) > 1:
                todo += [batch[len(batch) // 2 :], batch[: len(batch) // 2]]
                continue
            number, text = batch[0]
            smaller = split(text, overlap)
            if not smaller:
                raise
            todo += [[(number, p)] for p in reversed(smaller)]
            continue
        for (number, text), vector in zip(batch, found, strict=True):
            yield number, parts[number], text, vector
            parts[number] += 1


def resilient(chunks: DataFrame, embed: Model, batch_size: int, overlap: int) -> DataFrame:
    """Chunks (document_id, chunk_no, text) with their vectors; a chunk that was split has several parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                some = frame.iloc[start : start + batch_size]
                made = [(some["document_id"].iloc[i], some["chunk_no"].iloc[i], part, text, vector) for i, part, text, vector in vectors(some["text"].tolist(), embed, overlap)]
                yield pd.DataFrame(made, columns=["document_id", "chunk_no", "part", "text", "vector"])

    return chunks.select("document_id", "chunk_no", "text").mapInPandas(run, SCHEMA)
