"""Quality classifier by co-training of two views.

The text view sees what a document says: its byte histogram, its variety of words and repetition.
The page view sees what is known about it: language, source, size and layout. Both start from a
bounded sample of labelled documents. In each round, each view's classifier labels the unlabelled
pool; the documents it is surest of, in the sample's class shares, go into the other view's training
set with those labels. At the end both views are calibrated on labelled documents that were held
out, and the calibrated views are combined by a logistic model into the score of every document.

Fitting uses at most MAX_LABELS labelled and MAX_POOL pool documents, those with the smallest hashes
of doc_id, so it is the same at every run. Scores cover all rows.

Cases: null and empty texts have zero features and are scored; null languages and sources are
values of their own; labels without document, null labels and documents labelled twice (smallest
label counts) do no harm; with no labels or only one class, all documents are kept at the share of
good labels (1 if none); very long texts are read whole; an empty table gives an empty one; other
columns pass through untouched, but for ones named quality_score and quality_kept, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import pieces

MAX_LABELS = 8000
MAX_POOL = 8000
ROUNDS = 4
GROW = 0.05
HELD_OUT = 4
KEEP_ABOVE = 0.5
HASHED = 64
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~!"
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
TEXT_FEATURES = 256 + 9
PAGE_FEATURES = HASHED + 6


def features(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """The text view's numbers, then the page view's."""
    out = np.zeros(TEXT_FEATURES + PAGE_FEATURES, np.float32)
    for kind, value in (("lang", lang), ("source", source)):
        out[TEXT_FEATURES + zlib.crc32(f"{kind}\0{'' if value is None else '=' + value}".encode()) % HASHED] = 1
    size = len(text)
    if size:
        out[:256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size)
        words, lines = text.split(), text.split(b"\n")
        n = max(1, len(words))
        out[256] = len(set(words)) / n
        out[257] = sum(map(eq, words, words[1:])) / n
        out[258] = len(set(lines)) / len(lines)
        out[259] = n / size
        out[260] = np.log1p(size / n)
        symbols, capitals, small = (len(text) - len(text.translate(None, c)) for c in (SYMBOLS, CAPITALS, SMALL))
        out[261] = symbols / n
        out[262] = np.log1p(10 * symbols / n)
        out[263] = capitals / max(1, capitals + small)
        out[264] = np.log1p(symbols)
        out[TEXT_FEATURES + HASHED :] = (np.log1p(size), np.log1p(len(lines)), np.log1p(size / len(lines)), np.log1p(max(map(len, lines))), n / size, (size - len(text.decode("utf-8", "replace"))) / size)
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = 1.0
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
        w = np.zeros(z.shape[1])
        damp = np.full(z.shape[1], ridge)
        damp[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(damp), z.T @ (y - p) - damp * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Model:
    """Two calibrated views and their combination; without views, a constant."""

    prior: float
    text: Logistic | None = None
    page: Logistic | None = None
    calibrate: tuple[Logistic, Logistic] | None = None
    combine: Logistic | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.combine is None:
            return np.full(len(x), self.prior)
        views = np.column_stack([c.logit(v.logit(part)[:, None]) for c, v, part in zip(self.calibrate, (self.text, self.page), _views(x), strict=True)])
        return 1 / (1 + np.exp(-self.combine.logit(views)))


def _views(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]


def co_train(x: np.ndarray, y: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS, grow: float = GROW) -> Model:
    prior = float(y.mean()) if len(y) else 1.0
    held = np.arange(len(y)) % HELD_OUT == 0
    if min(np.bincount(y[held].astype(int), minlength=2).min(), np.bincount(y[~held].astype(int), minlength=2).min()) == 0:
        return Model(prior)
    seen, open_ = _views(x[~held]), _views(pool)
    train = [(part, y[~held]) for part in seen]
    free = [np.ones(len(pool), bool), np.ones(len(pool), bool)]
    for _ in range(rounds):
        fitted = [Logistic.fit(*t) for t in train]
        for giver in (0, 1):
            taker = 1 - giver
            at = np.flatnonzero(free[taker])
            if not len(at):
                continue
            logit = fitted[giver].logit(open_[giver][at])
            order = np.argsort(logit, kind="stable")
            n = max(2, int(grow * len(pool)))
            good, bad = order[::-1][: round(n * prior)], order[: n - round(n * prior)]
            good, bad = at[good[logit[good] > 0]], at[bad[logit[bad] < 0]]
            free[taker][np.concatenate([good, bad])] = False
            have, label = train[taker]
            train[taker] = np.vstack([have, open_[taker][good], open_[taker][bad]]), np.concatenate([label, np.ones(len(good)), np.zeros(len(bad))])
    text, page = (Logistic.fit(*t) for t in train)
    raw = [v.logit(part)[:, None] for v, part in zip((text, page), _views(x[held]), strict=True)]
    calibrate = tuple(Logistic.fit(r, y[held]) for r in raw)
    both = np.column_stack([c.logit(r) for c, r in zip(calibrate, raw, strict=True)])
    return Model(prior, text, page, calibrate, Logistic.fit(both, y[held]))


def _feature_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        rows = [features((t or "").encode(), lang, source).tobytes() for t, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_pool: int = MAX_POOL) -> Model:
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    known = known.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi").orderBy(*order).limit(max_labels)
    pool = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().orderBy(*order).limit(max_pool)
    wanted = {r["doc_id"]: None for r in pool.collect()}
    wanted |= {r["doc_id"]: r["y"] for r in known.collect()}  # labelled documents aren't in the pool
    picked = docs.sparkSession.createDataFrame(list(wanted.items()), "doc_id long, y int")  # max_labels + max_pool rows at most
    texts = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source"))).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rows = {}
    for r in texts.mapInArrow(_feature_column, "doc_id long, x binary").toLocalIterator():
        rows[r["doc_id"]] = max(bytes(r["x"]), rows.get(r["doc_id"], b""))  # one row of those that share a doc_id
    ids = sorted(rows)
    x = np.array([np.frombuffer(rows[i], np.float32) for i in ids]).reshape(len(ids), TEXT_FEATURES + PAGE_FEATURES)
    mask = np.array([wanted[i] is not None for i in ids], bool)
    y = np.array([wanted[i] for i in ids if wanted[i] is not None], np.float64)
    return co_train(x[mask], y, x[~mask])


def classify(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_pool: int = MAX_POOL, threshold: float = KEEP_ABOVE) -> DataFrame:
    """All rows and columns of docs, with quality_score and quality_kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labels, max_pool))
    names = docs.columns
    slots = {c: f"c{i}" for i, c in enumerate(names)}  # whatever the columns are called, ours don't clash
    renamed = docs.toDF(*slots.values())
    text, lang, source = (slots[c] for c in ("text", "lang", "source"))
    schema = T.StructType([*renamed.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            columns = (batch.column(c).to_pylist() for c in (text, lang, source))
            x = np.array([features((t or "").encode(), lang, source) for t, lang, source in zip(*columns, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(x), pa.float64())], names=[*batch.schema.names, "score"])

    scored = renamed.mapInArrow(run, schema)
    return scored.select(*(F.col(slots[c]).alias(c) for c in names if c not in ("quality_score", "quality_kept")), F.round("score", 6).alias("quality_score"), (F.col("score") >= threshold).alias("quality_kept"))
