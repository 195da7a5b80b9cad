"""Mixing sources to target weights, by packed blocks, multinomial shards and index permutations.

1. Each source's words, its documents one after another, are packed into blocks of `block_words`.
   Positions come from three-level prefix sums: documents are salted into cells of bounded size, cells
   into groups, so that no source's documents or cells meet in one task.
2. Targets follow from weights: a source stops at `cap` times its size, the excess is shared among
   the others by weight. Rounds of exact sums over the table of sources find the rate.
3. A source's quota is whole passes over its blocks, then blocks of one more pass until its target is
   reached to the word; its very last slot may take only the front of its block. Its slots are dealt to
   the output shards by a multinomial draw, so each shard's mixture varies around the weights and the
   quotas are met. The number of shards follows from the number of slots.
4. Slot j of a source reads block perm(j): each pass has a pseudorandom permutation of its own, a
   Feistel network walked until it stays inside the range. Blocks and slots are joined by index.

Weights 3, 1, 2 go to the sources by code point, null last, repeating. Sources are a table: their
number isn't limited.

Cases: null and empty texts have no words and are taken 0 times; a null source is a source; very
long documents span many blocks; repeated rows are documents of their own, told apart by row; an
empty table, or one without words, gives targets of 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import ROW, Staged, source_rows, splitmix

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all sizes: 150 %
CAP = 2
BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
TASK_SLOTS = 1 << 18
SEED = 17
CELL_DOCS = 4_000
GROUP_CELLS = 1_000
SLICE = 1 << 18


def numbered(staged: Staged, sources: DataFrame) -> DataFrame:
    """Adds source_no, the place of each source by code point, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    sorted_ = staged.put(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    before, offsets = 0, {}
    for r in sorted(sorted_.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        offsets[r["part"]] = before
        before += r["count"]
    base = F.array(*(F.lit(offsets.get(i, 0)) for i in range(max(offsets, default=0) + 1)))
    return sorted_.withColumn("source_no", (F.element_at(base, part + 1) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("at")


def with_targets(sources: DataFrame, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """Adds the target of each source: share of all sizes dealt by weight, none above cap * its size, the excess dealt again.

    The rate is left / (share[1] * open) words for each unit of weight. It only rises, and the sources that
    it fills stay full, so each round is one sum over them.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total, open_ = (int(x or 0) for x in sources.agg(F.sum(exact("source_size")), F.sum("weight")).first())
    left, full = share[0] * total, -1
    while True:
        fills = F.lit(Decimal(left)) * F.col("weight") > F.lit(Decimal(cap * share[1] * open_)) * exact("source_size")
        r = sources.agg(F.count(F.when(fills, 1)).alias("n"), F.sum(F.when(fills, exact("source_size"))).alias("size"), F.sum(F.when(~fills, F.col("weight"))).alias("open")).first()
        if r["n"] == full:
            break
        full, left, open_ = r["n"], share[0] * total - cap * share[1] * int(r["size"] or 0), int(r["open"] or 0)
    dealt = (F.lit(Decimal(left)) * F.col("weight")).cast("double") / float(share[1] * max(1, open_))
    return sources.withColumn("target", F.when(fills, (cap * F.col("source_size")).cast("double")).otherwise(dealt))


def quota(words: int, size: int, block_words: int, source_no: int) -> tuple[int, int | None]:
    """(slots, words of the last slot where it takes only the front of its block) that take so many words."""
    if not size or not words:
        return 0, None
    blocks = -(-size // block_words)
    passes, rest = divmod(words, size)
    if not rest:
        return passes * blocks, None
    short = size - (blocks - 1) * block_words
    at = int(permuted(np.array([blocks - 1]), blocks, _key(source_no, passes), inverse=True)[0])  # the slot of the short block
    more = -(-rest // block_words)
    if more > at:
        more = at + 1 if rest <= at * block_words + short else -(-(rest + block_words - short) // block_words)
    taken = more * block_words - (block_words - short if more > at else 0)
    last = short if more == at + 1 else block_words
    return passes * blocks + more, last - (taken - rest) if taken > rest else None


def draw_shards(slots: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A multinomial draw: how many of a source's slots go to which shard, as (shards, counts above 0)."""
    rng = np.random.default_rng(seed)
    if slots < shards:
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    counts = rng.multinomial(slots, np.full(shards, 1 / shards))
    return np.flatnonzero(counts), counts[counts > 0]


def _key(source_no: int, passes: int) -> int:
    return (source_no << 20) + passes + (SEED << 44)


def _feistel(x: np.ndarray, half: int, key: int, inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in (3, 2, 1, 0) if inverse else range(4):
        step = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if inverse:
            left, right = right ^ (splitmix(left + step) & mask), left
        else:
            left, right = right, left ^ (splitmix(right + step) & mask)
    return (left << np.uint64(half)) | right


def permuted(slot: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse: four Feistel rounds, walked until inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out, todo = slot.astype(np.uint64), np.arange(len(slot))
    while len(todo):
        out[todo] = _feistel(out[todo], half, key, inverse)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


RUN = "shard long, source_no int, first long, n long, blocks long, slots long, part long"
SLOT = "shard long, slot long, source_no int, pass int, block long, part long"


def _runs(shards: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                at, counts = draw_shards(r.slots, shards, seed + 1_000_003 * r.source_no)
                yield pd.DataFrame({"shard": at, "source_no": r.source_no, "first": np.cumsum(counts) - counts, "n": counts, "blocks": r.blocks, "slots": r.slots, "part": r.part})

    return run


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            for start in range(r.first, r.first + r.n, SLICE):
                slot = np.arange(start, min(start + SLICE, r.first + r.n), dtype=np.int64)
                passes, at = slot // r.blocks, slot % r.blocks
                block = np.empty_like(slot)
                for p in np.unique(passes):
                    block[passes == p] = permuted(at[passes == p], r.blocks, _key(r.source_no, int(p)))
                part = np.where(slot == r.slots - 1, r.part, -1)
                yield pd.DataFrame({"shard": r.shard, "slot": slot, "source_no": np.int32(r.source_no), "pass": passes.astype(np.int32), "block": block, "part": part})


def _quotas(block_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [quota(int(w), int(s), block_words, int(n)) for w, s, n in zip(frame["words"], frame["source_size"], frame["source_no"], strict=True)]
            yield pd.DataFrame({"source_no": frame["source_no"], "blocks": -(-frame["source_size"] // block_words), "slots": [f[0] for f in found], "part": [-1 if f[1] is None else f[1] for f in found]})

    return run


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, staged: Staged | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (documents, spans, slots).

    documents: _row, doc_id, source_no, size, source_size, target, start (first word in its source).
    spans: _row, source_no, block, at (first word within the document), words, ahead (words of the block before them).
    slots: shard, slot, source_no, pass, block, part (words that it takes of its block, -1: all). Spans and slots joined
    on (source_no, block) are the mix.
    """
    spark = docs.sparkSession
    staged = staged or Staged(spark)
    base = source_rows(staged, docs, "doc_id", "source", "text")
    sized = staged.put(base.select(ROW, F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    total = sized.count()
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", ROW)), F.lit(max(1, -(-total // CELL_DOCS))))  # by doc_id, so that the layout of the input doesn't matter
    sources = numbered(staged, sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("source_no") % len(WEIGHTS) + 1)
    sources = staged.put(with_targets(staged.put(sources.withColumn("weight", weight))))
    quotas = staged.put(sources.select("source_no", "source_size", F.round("target").cast("long").alias("words")).mapInPandas(_quotas(block_words), "source_no int, blocks long, slots long, part long").where("slots > 0"))
    slots_in_all = quotas.agg(F.sum("slots")).first()[0] or 0
    runs = staged.put(quotas.mapInPandas(_runs(max(1, -(-slots_in_all // shard_slots)), seed), RUN))
    # Staged, so that the slots' own size, not that of their runs, decides how they are joined.
    slots = staged.put(runs.repartition(max(8, -(-slots_in_all // TASK_SLOTS)), "shard").mapInPandas(_expand, SLOT))

    cells = sized.where("size > 0").groupBy("source", salt.alias("cell")).agg(F.sum("size").alias("cell_size"))
    before = _before(cells)
    placed = (
        sized.withColumn("cell", salt)
        .withColumn("inner", F.sum("size").over(Window.partitionBy("source", "cell").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .alias("d")
        .join(before.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.cell") == F.col("b.cell")), "left")
        .select("d.*", F.coalesce("b.base", F.lit(0)).alias("base"))
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select(ROW, "doc_id", "d.source", "source_no", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))
    )
    placed = staged.put(placed)
    staged.drop(sized)
    width = F.lit(block_words)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
    low, high = F.greatest("start", F.col("block") * width), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width)
    spans = (
        placed.where("size > 0")
        .select(ROW, "source_no", "start", "size", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
        .select(ROW, "source_no", "block", (low - F.col("start")).alias("at"), (high - low).alias("words"), (low - F.col("block") * width).alias("ahead"))
    )
    return placed, spans, slots


def _before(cells: DataFrame) -> DataFrame:
    """(source, cell, base): the words of a source in its cells before each, by groups of cells first."""
    group = F.floor(F.col("cell") / GROUP_CELLS).alias("group")
    running = lambda size, *keys: F.sum(size).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col(size)
    within = cells.select("source", group, "cell", running("cell_size", "source", group, "cell").alias("inner"))
    groups = cells.groupBy("source", group).agg(F.sum("cell_size").alias("group_size"))
    ahead = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), running("group_size", "source", "group").alias("outer"))
    return within.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).select("source", "cell", (F.col("inner") + F.col("outer")).alias("base"))


def _front(part: Column) -> Column:
    """How many of a span's words lie in the first `part` words of its block."""
    return F.greatest(F.lit(0), F.least(F.col("words"), part - F.col("ahead")))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words that the mix takes of it.

    See the module's docstring for nulls, empty texts and tables, repeated rows and clashing columns.
    """
    placed, spans, slots = mix(docs, block_words, shard_slots, seed)
    times = slots.groupBy("source_no", "block").agg(F.count(F.when(F.col("part") < 0, 1)).alias("times"), F.coalesce(F.sum(F.when(F.col("part") >= 0, F.col("part"))), F.lit(0)).alias("front"))
    taken = spans.join(times, ["source_no", "block"]).groupBy(ROW).agg(F.sum(F.col("words") * F.col("times") + _front(F.col("front"))).alias("taken"))
    return placed.join(taken, ROW, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row per document and pass, holding the words taken in that pass.

    A pass that takes all of a document keeps its text as it stands; one that takes some of its
    blocks joins their words by single spaces, in order. Columns: doc_id, text, lang, source,
    n_chars (code points of the new text). Documents without words have nothing to take.
    """
    staged = Staged(docs.sparkSession)
    rows = source_rows(staged, docs, "doc_id", "text", "lang", "source")
    placed, spans, slots = mix(rows.drop(ROW), block_words, shard_slots, seed, staged)
    held = spans.join(slots.select("source_no", "pass", "block", "part"), ["source_no", "block"])
    held = held.withColumn("words", F.when(F.col("part") < 0, F.col("words")).otherwise(_front(F.col("part")))).where("words > 0")
    pieces = held.groupBy(ROW, "pass").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("pieces"))
    pieces = pieces.join(placed.select(ROW, "size"), ROW).select(ROW, "pass", F.when(F.col("words") < F.col("size"), F.col("pieces")).alias("pieces"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    cut = F.concat_ws(" ", F.flatten(F.transform("pieces", lambda p: F.slice("words", p["at"].cast("int") + 1, p["words"].cast("int")))))
    return (
        rows.join(pieces, ROW)
        .select("doc_id", "text", "lang", "source", "pieces", F.when(F.col("pieces").isNotNull(), words).alias("words"))
        .select("doc_id", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(cut).alias("text"), "lang", "source")
        .withColumn("n_chars", F.length("text").cast("long"))
    )
