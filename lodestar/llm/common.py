"""Shared helpers: the scratch folder, staged tables, row keys and Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = b" \t\n\x0b\x0c\r"
ROW = "_lodestar_row"

_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which all executors share.

    Only where the setting is absent on one machine (tests) a temporary folder takes its place; a cluster must set it.
    The folder goes when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        root = f"{base.rstrip('/')}/lodestar-{app}-{uuid.uuid4().hex[:8]}"
        _roots[app] = root
        atexit.register(_forget, spark, root)
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before Python
        return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """Tables written to the scratch folder: lineage is cut and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a staged table that no later plan reads."""
        path = self.paths.pop(id(df), None)
        if path:
            drop_path(self.spark, path)


def with_row(df: DataFrame) -> DataFrame:
    """Adds ROW, a number of each input row that is the same whenever the same scan runs again.

    It tells rows apart that share a doc_id. Call it directly on a table scan (or a staged table):
    scans deal out files and rows in the same way each time, results of a shuffle need not.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def source_rows(staged: Staged, df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ROW; anything but a plain scan is staged first, so that ROW is stable."""
    picked = df.select(*columns)
    if not _plain_scan(df):
        picked = staged.put(picked)
    return with_row(picked)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with a column named ROW (in any case) renamed, and what to rename back with withColumnsRenamed."""
    taken = {c.lower() for c in df.columns}
    other = next(f"{ROW}_{i}" for i in range(len(taken) + 1) if f"{ROW}_{i}" not in taken)
    names = {c: other for c in df.columns if c.lower() == ROW}
    return df.withColumnsRenamed(names), {new: old for old, new in names.items()}


def _plain_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def binary_column(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes in the column; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
