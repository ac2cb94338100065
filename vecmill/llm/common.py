"""What the operators share: the cluster's shared folder, written tables, range buckets."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is
    unset, a temporary folder serves, but only in local mode, where all is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="vecmill-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The DataFrame written to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold fewer rows than Spark's default of 10,000, so that a batch of
    long ones fits beside others in an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a Python worker keeps between tasks: one operator's caches at a time. The cyclic garbage
    collector is off meanwhile; caches hold no cycles, and to walk them costs a quarter of the time."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
        gc.collect()
        gc.disable()
    return _HELD[name]


def release() -> None:
    """Frees the caches that another operator left in this worker, and what its allocators kept."""
    if _HELD:
        _HELD.clear()
        gc.enable()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


LOWEST = -(2**63)


def range_bounds(df: DataFrame, column: str, n: int) -> np.ndarray:
    """n-1 approximate quantiles of an integer column, ascending; a value that holds
    several quantiles is there several times. Nulls count as the lowest value."""
    if n <= 1:
        return np.zeros(0, np.int64)
    at = [k / n for k in range(1, n)]
    got = df.select(F.coalesce(F.col(column), F.lit(LOWEST)).alias("k")).agg(F.percentile_approx("k", at, max(10_000, 20 * n)).alias("q")).first()["q"]
    return np.array(got or [], np.int64)


def bucket_of(bounds: np.ndarray, keys: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The range bucket of each (key, tie), monotone in that order. A key that fills
    several buckets alone is spread over them by its ties (a 64-bit hash)."""
    lo = np.searchsorted(bounds, keys, "left")
    many = np.searchsorted(bounds, keys, "right") - lo
    part = (tie.astype(np.float64) + 2.0**63) / 2.0**64
    return (lo + np.minimum((part * many).astype(np.int64), np.maximum(many - 1, 0))).astype(np.int32)


def longs(column: pa.Array, null: int = LOWEST) -> np.ndarray:
    return np.asarray(column.fill_null(null) if column.null_count else column, dtype=np.int64)


def slices(batches, rows: int = 256, size: int = 4 << 20):
    """Cuts Arrow batches into smaller ones of some rows, and of about some bytes of memory."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes / batch.num_rows * rows > size:
            step = max(1, int(size / (batch.nbytes / batch.num_rows)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
