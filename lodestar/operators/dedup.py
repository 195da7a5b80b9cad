"""Duplicate variants within rankings: greedy, first wins, folded per query in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.paths import directory, extension, filename
from lodestar.functions.text import indel

# Extensions whose files may be variants of one document, and the near-text limits.
VARIANTS = ("odt", "pdf", "doc", "docx", "rtf", "txt", "md", "html")
EXACT_CHARS, NEAR_CHARS, LENGTH_RATIO, TEXT_RATIO = 120, 500, 0.8, 0.96


def file_signature(path: Column) -> Column:
    """Struct (dir, stem, suffix), null unless the extension is one of VARIANTS."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(filename(path), r"\.[^.]*$", "")), r"[^\p{L}\p{N}_]+", "")
    return F.when(extension(path).isin(*VARIANTS) & (stem != ""), F.struct(F.lower(directory(path)).alias("dir"), stem.alias("stem"), extension(path).alias("suffix")))


def trusted_hash(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.rlike("^[0-9a-f]{32}$"), low)


def near_text(a: str, b: str) -> bool:
    """Equal from 120 characters on; similar from 500 on, if the lengths and the matcher's ratio allow."""
    if not a or not b:
        return False
    if a == b:
        return len(a) >= EXACT_CHARS
    short, long = sorted((len(a), len(b)))
    if short < NEAR_CHARS or short < LENGTH_RATIO * long:
        return False
    if indel(a, b) < 100 * TEXT_RATIO:  # matching blocks are a common subsequence, so this bounds the matcher's ratio
        return False
    return matching(a, b) * 2.0 / (len(a) + len(b)) >= TEXT_RATIO


def _longest(a: str, b: str) -> tuple[int, int]:
    """(start in a, size) of the first longest common substring, by a suffix automaton of b."""
    steps: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in b:
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(steps[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    state = length = best = end = 0
    for i, c in enumerate(a):
        while state and c not in steps[state]:
            state = link[state]
            length = size[state]
        if c in steps[state]:
            state = steps[state][c]
            length += 1
        if length > best:
            best, end = length, i + 1
    return end - best, best


def matching(a: str, b: str) -> int:
    """The characters in the matching blocks of difflib's SequenceMatcher without junk, in time that long texts allow."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        start, size = _longest(a[alo:ahi], b[blo:bhi])
        if size:
            i = alo + start
            j = b.index(a[i : i + size], blo, bhi)
            total += size
            todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


OUT = "query_id long, document_id string, rank int, representative string, reason string, variants array<string>"


def group_variants(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Folds each query's ranking: hash first, then same stem with another suffix, then near text.

    hits: query_id, document_id, rank, hash, dir, stem, suffix, text. A query's pool is bounded by
    its retrieval limit. Representatives are re-ranked; with `most`, the fold stops there.
    """

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        rows = []
        for r in pool.sort_values("rank").to_dict("records"):
            match = next(((k, why) for k in kept if (why := _same(k, r))), None)
            if match is None:
                if most is not None and len(kept) >= most:
                    break
                kept.append(r | {"variants": []})
                rows.append((kept[-1], r["document_id"], "first"))
            else:
                match[0]["variants"].append(r["document_id"])
        out = [(r["query_id"], d, i + 1, d, why, k["variants"]) for i, (k, d, why) in enumerate(rows) for r in (k,)]
        return pd.DataFrame(out, columns=["query_id", "document_id", "rank", "representative", "reason", "variants"])

    return hits.groupBy("query_id").applyInPandas(fold, OUT)


def _same(a: dict, b: dict) -> str:
    if a["hash"] and a["hash"] == b["hash"]:
        return "hash"
    if a["stem"] and (a["dir"], a["stem"]) == (b["dir"], b["stem"]) and a["suffix"] != b["suffix"]:
        return "variant"
    return "text" if near_text(a["text"], b["text"]) else ""


def promote_authorized(groups: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each group (query_id, group_id, document_id, position) is shown by its first authorized member; groups without one go."""
    seen = groups.join(allowed, "document_id", "left_semi")
    return seen.groupBy("query_id", "group_id").agg(F.min_by("document_id", "position").alias("document_id"), F.min("position").alias("position"))
