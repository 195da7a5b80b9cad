"""Byte-pair encoding by a tokenization automaton, and decoding by arc labels.

The automaton reads tokens: from the state behind token t there is an arc labelled w where w may
follow t. It starts with one state and a loop for every byte. Each merge u+v -> w, in rank order,
adds a gadget: the state behind u becomes a copy of its own without the arc v; every state that
(still) has an arc u gets an arc w, which leads where v led. What is left accepts exactly the token
sequences that byte-pair encoding produces, one per text. All arcs with one label lead to one state.

The driver compiles the whole transition table. A gadget's cut (u, v) also takes the arcs w that grew
from v after it, away from the states that grew from u after it. With the labels in post-order of
their left parts, children by rank, those arcs are one interval, so a state's row is a sorted list of
the bounds of what it lacks: some 800,000 intervals for 50,000 states, where a dense table would have
2,500,000,000 cells. An arc is there if the bounds before its column are even in number.

A pre-split word is read byte by byte, once, forwards: the arcs that are open behind a byte (how far
each is spelled, and the state it left) follow from those before it by the trie of labels and the
transition table. Every prefix has exactly one token sequence, so at most one open arc may end behind
a byte, and its label is the last token of that prefix; the labels, read from the end of the word,
are its tokens. The new words of a batch are read in sorted order, so shared prefixes are read once.

Texts are split at special tokens, then by the vocabulary's pattern. Known words are kept up to
MAX_WORDS and until the task ends.

Cases: null text counts as empty and has no tokens; words of any length are encoded whole; text that
spells a special token is that token; repeated rows give repeated results; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern where a text is ASCII; its white space leaves out what only Python counts as such.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MAX_WORDS = 200_000
MAX_PIECE = 200_000
SHARED_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabulary files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(shown)))
    return letters


class Automaton:
    """Labels, the trie that spells them, and the compiled transition table."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]) -> None:
        """labels: bytes of each token; merges: (u, v, w) in rank order; special: texts that are tokens as they stand."""
        size = max([*labels, *special.values()]) + 1
        self.special, self.labels = special, [labels.get(i, b"") for i in range(size)]
        gadgets = Gadgets(size)
        for merge in merges:
            gadgets.add(*merge)
        made = [t for t, label in labels.items() if len(label) == 1 or gadgets.rank[t] >= 0]
        self.column, self.first, self.bounds = gadgets.table(made)
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends, self.inner = [-1], bytearray(1)
        for token in made:
            self._spell(token)
        self.sizes = array("i", map(len, self.labels))
        for text, token in special.items():
            self.labels[token] = text.encode()
        self._start()

    def _start(self) -> None:
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split, self.split_ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.words: dict[str | int, bytes] = {}
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("marks", "split", "split_ascii", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def forget(self) -> None:
        """Lets go of the words that texts have added. Special tokens are known by their number."""
        self.words.clear()
        self.words.update((token, array("I", [token]).tobytes()) for token in self.special.values())

    def _spell(self, token: int) -> None:
        node = 0
        for byte in self.labels[token]:
            after = self.trie.get(node << 8 | byte)
            if after is None:
                after = self.trie[node << 8 | byte] = len(self.ends)
                self.ends.append(-1)
                self.inner.append(0)
                self.inner[node] = 1
            node = after
        self.ends[node] = token

    def read(self, arcs: list[tuple[int, int]], data: bytes, opened: list[list[tuple[int, int]]] | None, last: list[int]) -> None:
        """Reads bytes from a set of open arcs (trie node and state left, the longest first), adding the label that ends
        behind each byte to `last` and the arcs that are open there to `opened`."""
        get, ends, inner, column, first, bounds = self.trie.get, self.ends, self.inner, self.column, self.first, self.bounds
        for byte in data:
            after, label = [], -1
            for node, held in arcs:
                node = get(node << 8 | byte)
                if node is None:
                    continue
                if label < 0:
                    ending = ends[node]
                    if ending >= 0 and (held < 0 or not (bisect_right(bounds, column[ending], first[held], first[held + 1]) - first[held]) & 1):
                        label = ending
                if inner[node]:
                    after.append((node, held))
            after.append((0, label))
            last.append(label)
            arcs = after
            if opened is not None:
                opened.append(arcs)

    def _path(self, last: list[int], at: int) -> array:
        """The labels that lead to a position, from the labels that end at each."""
        out, sizes = [], self.sizes
        while at:
            label = last[at]
            out.append(label)
            at -= sizes[label]
        out.reverse()
        return array("I", out)

    def run(self, word: bytes) -> array:
        """The labels of the one accepting path that spells the word."""
        last = [0]
        self.read([(0, -1)], word, None, last)
        return self._path(last, len(word))

    def learn(self, words: set[str]) -> None:
        """Encodes words, shared prefixes once."""
        opened, last, before, known = [[(0, -1)]], [0], b"", self.words
        for word, text in sorted((w.encode(), w) for w in words):
            if len(word) > SHARED_BYTES:
                known[text] = self.run(word).tobytes()
                continue
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del opened[depth + 1 :], last[depth + 1 :]
            self.read(opened[depth], word[depth:], opened, last)
            before = word
            known[text] = self._path(last, len(word)).tobytes()

    def _pieces(self, text: str) -> Iterator[list[str | int]]:
        """The text's words and special tokens, in lists of bounded length."""
        split = self.split_ascii if text.isascii() else self.split
        at, end = 0, len(text)
        while at < end:
            mark = self.marks.search(text, at) if self.marks else None
            stop = mark.start() if mark else end
            if stop - at <= MAX_PIECE:
                yield split.findall(text[at:stop] if stop - at < end else text)
            else:
                found = (m[0] for m in split.finditer(text[at:stop]))
                while some := list(islice(found, MAX_PIECE)):
                    yield some
            if mark:
                yield [self.special[mark[0]]]
            at = mark.end() if mark else end

    def encode_all(self, texts: list[str]) -> list[array]:
        """Token ids of each text, as unsigned 32-bit numbers."""
        out = [array("I") for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for found in self._pieces(text):
                held.append((i, found))
                size += len(found)
                if size >= MAX_PIECE:
                    self._join(held, out)
                    held, size = [], 0
        self._join(held, out)
        return out

    def _join(self, held: list[tuple[int, list[str | int]]], out: list[array]) -> None:
        seen = set().union(*(found for _, found in held))
        new = seen - self.words.keys()
        if len(self.words) + len(new) > MAX_WORDS:
            self.forget()
            new = seen - self.words.keys()
        self.learn(new)
        for i, found in held:
            out[i].frombytes(b"".join(map(self.words.__getitem__, found)))
        for word in new:
            if len(word) > SHARED_BYTES:
                del self.words[word]

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Gadgets:
    """The automaton under construction: the merge that made a label, and the rank at which an arc was cut."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.grown: dict[int, list[int]] = {}  # labels that grew from one as its left part, by rank
        self.cuts: dict[int, dict[int, int]] = {}  # state -> label -> rank

    def add(self, u: int, v: int, w: int) -> None:
        rank = self.count = getattr(self, "count", -1) + 1
        if not self.open(u, v, rank):
            return  # the arc is cut already: this merge never applies
        self.cuts.setdefault(u, {})[v] = rank
        self.grown.setdefault(u, []).append(w)
        self.rank[w], self.left[w], self.right[w] = rank, u, v

    def open(self, t: int, w: int, time: int) -> bool:
        """Whether the state behind t has the arc w once the gadgets of ranks below `time` stand."""
        rank = self.rank
        while True:
            if self.cuts.get(t, {}).get(w, time) < time:
                return False
            if rank[t] < 0 and rank[w] < 0:
                return True
            if rank[w] >= rank[t]:  # the arc w came where the arc of its left part was, that merge's own cut made
                time, w = rank[w] + 1, self.left[w]
            else:  # the state behind t began as the one behind its right part
                time, t = rank[t], self.right[t]

    def columns(self, made: list[int]) -> tuple[list[int], list[int]]:
        """By label: its place in post-order of left parts, and the first place of those that grew from it."""
        column, first, n = [0] * self.size, [0] * self.size, 0
        for root in (t for t in made if self.rank[t] < 0):
            todo = [(root, 0)]
            while todo:
                label, at = todo.pop()
                if not at:
                    first[label] = n
                grown = self.grown.get(label, ())
                if at < len(grown):
                    todo += [(label, at + 1), (grown[at], 0)]
                else:
                    column[label] = n
                    n += 1
        return column, first

    def table(self, made: list[int]) -> tuple[list[int], list[int], array]:
        """(column of each label, first bound of each state, bounds of the intervals that states lack)."""
        column, first = self.columns(made)
        lacks: dict[int, list[tuple[int, int, int]]] = {}
        for u, cut in self.cuts.items():
            for v, rank in cut.items():
                grown = self.grown.get(v, ())
                later = bisect_left(grown, rank, key=self.rank.__getitem__)  # its own label counts where u is v
                lacks.setdefault(u, []).append((rank, first[grown[later]] if later < len(grown) else column[v], column[v] + 1))
        starts, bounds = [0], array("i")
        for state in range(self.size):
            held, at, time = [], state, len(self.rank) + len(self.cuts) + (1 << 40)
            while True:
                held += [(low, high) for rank, low, high in lacks.get(at, ()) if rank < time]
                if self.rank[at] < 0:
                    break
                time, at = self.rank[at], self.right[at]
            end = -1
            for low, high in sorted(held):
                if low > end:
                    bounds.extend((low, high))
                elif high > end:
                    bounds[-1] = high
                end = max(end, high)
            starts.append(len(bounds))
        return column, starts, bounds


def compile_merges(spec: str) -> Automaton:
    """From the JSON of a byte-level vocabulary file."""
    parsed = json.loads(spec)
    model, letters = parsed["model"], byte_letters()
    vocabulary = model["vocab"]
    special = {t["content"]: t["id"] for t in parsed.get("added_tokens") or ()}
    labels = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items() if t not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], special)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """One row per document: token count, the ids (null unless keep_ids) and digests of the ids and of the decoded text.

    The vocabulary file is read and compiled on the driver; its size bounds what goes to the executors.
    """
    compiled: Broadcast = docs.sparkSession.sparkContext.broadcast(compile_merges(Path(tokenizer).read_text(encoding="utf-8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled.value
        for batch in pieces(batches, "text"):
            counts, sums, texts, kept = [], [], [], []
            for ids in automaton.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(len(ids))
                sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
                kept.append(ids.tolist() if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string()), pa.array(kept, pa.list_(pa.int32()))],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )
        automaton.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
