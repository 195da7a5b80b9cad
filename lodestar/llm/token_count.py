"""Token counts by unigram scores, computed once for each prefix that pre-tokens share.

Each batch collects its distinct pre-tokens (words between ASCII white space, led by the word mark)
and walks them in sorted order, which is a depth-first walk of their trie: the forward state of a
prefix stays on a stack while words that share it follow. A state is the best score and the tokens
of the best split up to that depth, and the vocabulary nodes still open. At each terminal the
pre-token's count is stored; documents add up the counts of their words.

A piece's log score follows from its rank by Zipf's law; a character that no piece covers falls back
to its bytes, at a score below any piece. Of equal scores the split with fewer tokens counts.

Cases: null and empty texts have no tokens; very long words and texts are scored whole; repeated
rows give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MAX_WORDS = 300_000
BYTE_SCORE = -30.0


def rank_score(rank: int) -> float:
    return -math.log(rank + 2.7)


class PieceTrie:
    """The vocabulary as child tables and, where a piece ends, its score."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, score in scores.items():
            node = 0
            for c in piece:
                after = self.kids[node].get(c)
                if after is None:
                    after = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.score.append(None)
                node = after
            self.score[node] = score
        self.known: dict[str, tuple[int, float]] = {}

    def count(self, words: set[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of each word."""
        known, todo = self.known, sorted(words - self.known.keys())
        if len(known) + len(todo) > MAX_WORDS:
            found = {w: known[w] for w in words if w in known}
            known.clear()
        else:
            found = known
        kids, scores = self.kids, self.score
        # Per depth: best score, its tokens, and the open nodes as (node, score before, tokens before).
        best, tokens, opened, before = [0.0], [0], [[]], ""
        for word in todo:
            spelled = MARK + word
            depth, most = 0, min(len(before), len(spelled))
            while depth < most and before[depth] == spelled[depth]:
                depth += 1
            del best[depth + 1 :], tokens[depth + 1 :], opened[depth + 1 :]
            for c in spelled[depth:]:
                top, n = best[-1] + BYTE_SCORE * len(c.encode()), tokens[-1] + len(c.encode())
                after = []
                for node, score, used in (*opened[-1], (0, best[-1], tokens[-1])):
                    node = kids[node].get(c)
                    if node is None:
                        continue
                    after.append((node, score, used))
                    own = scores[node]
                    if own is not None:
                        total = score + own
                        if total > top or total == top and used + 1 < n:
                            top, n = total, used + 1
                best.append(top)
                tokens.append(n)
                opened.append(after)
            before = spelled
            found[word] = tokens[-1], best[-1]
        if found is not known and len(found) <= MAX_WORDS:
            known.update(found)
        return found


def read_model(path: str) -> list[str]:
    """The pieces of a sentence-piece file in rank order, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(maxsize=2)
def _trie(pieces: tuple[str, ...]) -> PieceTrie:
    return PieceTrie({p: rank_score(i) for i, p in enumerate(pieces)})


SCHEMA = "doc_id long, n_words long, n_tokens long, score double"


def count_tokens(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """One row per document: words, tokens and the summed log score of its best splits."""
    pieces: Broadcast = docs.sparkSession.sparkContext.broadcast(tuple(read_model(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(pieces.value)
        for batch in batches:
            texts = [WORD.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            found = trie.count(set().union(*texts))
            rows = [[found[w] for w in words] for words in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, rows), pa.int64()),
                    pa.array([sum(n for n, _ in r) for r in rows], pa.int64()),
                    pa.array([math.fsum(s for _, s in r) for r in rows], pa.float64()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    from lodestar.llm.common import pieces as cut

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(cut(batches, "text", 2 << 20))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(small, SCHEMA)
