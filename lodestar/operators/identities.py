"""Profiles that may be one: pairs by name within blocks, compared block by block with numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.ratios import Strings, candidates, ratios

# Scores of equal names, of names with equal ends, of ratios, and what a shared band adds.
EQUAL, ENDS, LIKE = 0.55, 0.52, ((96, 0.45), (92, 0.36), (88, 0.27))
SHARED, MOST = 0.35, 0.99
ROWS, PARTS, PIECE = 512, 8, 1 << 16
PACKED = "cell binary, part int, no int, block binary"
PAIRS = "id_a long, id_b long, ratio double, name double, shared double"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, name, band) that stand together by cell, as numbered blocks of ROWS rows at most."""

    def block(cell: bytes, no: int, rows: list[tuple]) -> pa.RecordBatch:
        part, sink = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["id", "name", "band"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_table(part)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.binary()), pa.array([no % PARTS], pa.int32()), pa.array([no], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[f.split()[0] for f in PACKED.split(", ")])

    last, no, rows = None, 0, []
    for batch in batches:
        for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (cell != last or len(rows) == ROWS):
                yield block(last, no, rows)
                no, rows = no + 1 if cell == last else 0, []
            last = cell
            rows.append(tuple(row))
    if rows:
        yield block(last, no, rows)


def _ends(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as (first word, last word) and whether they have two words or more."""
    words = [n.split(" ") for n in names]
    return np.array([w[0] + " " + w[-1] for w in words], object), np.array([len(w) > 1 for w in words], bool)


def _compare(near: bool):
    """Pairs of two blocks; near ones share the band, the others have different ones and equal ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (pa.ipc.open_stream(batch.column(c)[r].as_buffer()).read_all() for c in ("block_a", "block_b"))
                alone = batch.column("no_a")[r].as_py() == batch.column("no_b")[r].as_py()
                (names_a, code_a), (names_b, code_b) = (np.unique(np.array(t["name"].to_pylist(), object), return_inverse=True) for t in (a, b))
                (ends_a, long_a), (ends_b, long_b) = _ends(names_a.tolist()), _ends(names_b.tolist())
                x, y = Strings(names_a.tolist()), Strings(names_b.tolist())
                compatible = (ends_a[:, None] == ends_b) & long_a[:, None] & long_b
                wanted = compatible | (names_a[:, None] == names_b)
                if near:
                    for i, j in candidates(x, y, LIKE[-1][0]):
                        wanted[i, j] = True
                i, j = np.nonzero(wanted)
                ratio = np.full(wanted.shape, np.nan)
                ratio[i, j] = ratios(x, y, i, j)
                name = np.full(wanted.shape, np.nan)
                for least, value in reversed(LIKE):
                    name[ratio >= least] = value
                name[compatible] = ENDS
                name[names_a[:, None] == names_b] = EQUAL
                keep = ~np.isnan(name)
                ids_a, ids_b = (t["id"].to_numpy() for t in (a, b))
                band_a, band_b = (t["band"].to_numpy(zero_copy_only=False) for t in (a, b))
                for start in range(0, len(ids_a), max(1, PIECE // len(ids_b))):
                    rows = slice(start, start + max(1, PIECE // len(ids_b)))
                    met = keep[code_a[rows]][:, code_b]
                    met &= (ids_a[rows, None] < ids_b) if alone else (ids_a[rows, None] != ids_b)
                    if not near:
                        met &= band_a[rows, None] != band_b  # an unknown band equals none
                    p, q = np.nonzero(met)
                    if len(p):
                        p += start
                        u, v = ids_a[p], ids_b[q]
                        m, n = code_a[p], code_b[q]
                        columns = (np.minimum(u, v), np.maximum(u, v), ratio[m, n], name[m, n], np.full(len(p), SHARED if near else 0.0))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in PAIRS.split(", ")])

    return run


def _pairs(rows: DataFrame, cell: list, near: bool) -> DataFrame:
    """Each two blocks of a cell meet once; a cell's blocks are dealt to PARTS tasks."""
    keyed = rows.select(F.encode(F.to_json(F.struct(*cell)), "UTF-8").alias("cell"), "id", "name", "band")
    blocks = keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pack, PACKED)
    a = blocks.select("cell", "part", F.col("no").alias("no_a"), F.col("block").alias("block_a"))
    b = blocks.select("cell", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("no").alias("no_b"), F.col("block").alias("block_b"))
    met = a.join(b.hint("shuffle_merge"), ["cell", "part"]).where("no_a <= no_b")
    return met.select("no_a", "block_a", "no_b", "block_b").mapInArrow(_compare(near), PAIRS)


def suggestions(profiles: DataFrame, *block: str) -> DataFrame:
    """(id_a, id_b, ratio, score): pairs of profiles of one block by name, with the band of a balance as more evidence.

    profiles: id, name (folded), band and the blocking columns. Pairs of one band are compared by equal names, equal ends and
    ratio; pairs of different bands by equal names and equal ends only. Blocks of rows bound a task's memory; different
    names of a block are compared once.
    """
    band = F.col("band").cast("double") + 0.0  # no negative zero; what isn't a number equals itself, other than null
    held = profiles.where(" and ".join(f"{c} is not null" for c in ("id", "name", *block))).withColumn("band", F.when(F.isnan(band), F.lit(-sys.float_info.max)).otherwise(band))
    words = F.split("name", " ")
    same = _pairs(held.where("band is not null"), [*block, "band"], True)
    far = _pairs(held, [*block, F.element_at(words, 1).alias("first"), F.element_at(words, -1).alias("last")], False)
    score = F.round(F.least(F.col("name") + F.col("shared"), F.lit(MOST)), 3)
    return same.unionByName(far).select("id_a", "id_b", F.round("ratio", 4).alias("ratio"), score.alias("score"))
