"""Vector retrieval: cosine top-k of a batch of query vectors over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, STEP = 2048, 128
BROADCAST_BYTES = 64 << 20
PACKED = "ids array<long>, names array<string>, matrix binary"
BEST = "query_id long, chunk long, document_id string, score double"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, name, embedding) as blocks: ids, names and unit vectors; a zero vector has no direction and no score."""
    for batch in batches:
        batch = batch.filter(batch.column("embedding").is_valid())
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            rows = np.asarray(part.column("embedding").flatten()).astype(np.float64).reshape(part.num_rows, -1)
            norm = np.sqrt((rows * rows).sum(1))
            kept = np.flatnonzero(norm > 0)
            unit = rows[kept] / norm[kept, None]
            lists = [pa.array([part.column(c).take(pa.array(kept)).to_pylist()], pa.list_(k)) for c, k in (("id", pa.int64()), ("name", pa.string()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([unit.tobytes()], pa.binary())], names=["ids", "names", "matrix"])


def _blocks(rows: DataFrame, identity: str, name: str | None) -> DataFrame:
    named = F.col(name).cast("string") if name else F.lit(None).cast("string")
    return rows.select(F.col(identity).cast("long").alias("id"), named.alias("name"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_pack, PACKED)


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # views of the batch, not copies; scores of STEP queries at a time
                ids, asked = (batch.column(c)[r].values.to_numpy() for c in ("ids", "query_ids"))
                if not len(ids) or not len(asked):
                    continue
                names = batch.column("names")[r].values
                chunks, queries = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(len(i), -1) for c, i in (("matrix", ids), ("queries", asked)))
                for start in range(0, len(asked), STEP):
                    scores = queries[start : start + STEP] @ chunks.T
                    np.round(scores, 6, out=scores)
                    best = []
                    for row in scores:
                        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        some = np.flatnonzero(row >= least)
                        best.append(some[np.lexsort((ids[some], -row[some]))][:k])
                    query, place = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate(best)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[start + query]), pa.array(ids[place]), names.take(pa.array(place)), pa.array(scores[query, place])], names=[f.split()[0] for f in BEST.split(", ")])

    return run


def cosine_top_k(chunks: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, chunk, document_id, score, rank): the k nearest chunks of each query; the threshold comes after the limit.

    A stated batch of queries meets all chunks in blocks, one matrix product for each pair of blocks. Only a block's best k per
    query leave it. Blocks of queries go to the scan while they are small, else pairs of blocks are shuffled. Rows without a
    vector, or with a zero one, have no score.
    """
    asked = _blocks(queries, "query_id", None).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    size = asked.agg(F.sum(F.length("queries"))).first()[0] or 0
    pairs = _blocks(chunks, "chunk", "document_id").crossJoin(F.broadcast(asked) if size <= BROADCAST_BYTES else asked)
    scored = pairs.select("ids", "names", "matrix", "query_ids", "queries").mapInArrow(_nearest(k), BEST)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def best_chunk(hits: DataFrame) -> DataFrame:
    """The best chunk of each document, re-ranked without gaps."""
    first = Window.partitionBy("query_id", "document_id").orderBy("rank")
    kept = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank"))))
