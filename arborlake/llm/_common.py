"""Shared plumbing of the training-data operators: scratch tables, Arrow chunking, small hashing helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at once in a Python worker.
CHUNK_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, tuple[int, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). A temporary one only in local mode, where there are no other machines."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborlake-"))
        where = jsc.getCheckpointDir().get()
    return where


def until_exit(spark: SparkSession, path: str) -> None:
    """Results may read a scratch path as long as the application lives; it is deleted when that ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


@contextlib.contextmanager
def _without_shuffle_files(spark: SparkSession):
    """Shuffle files go with the query that made them. Queries of one session may overlap: the last one out restores the setting."""
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        count, before = _writing.get(key, (0, spark.conf.get(CLEANUP)))
        _writing[key] = count + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(key)
            if count > 1:
                _writing[key] = count - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/arborlake/{name}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def plan_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Size of ``df``: for plain file scans Catalyst's estimate, the bytes on disk; else the bytes of its texts, summed in one pass."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < 1 << 50 and "Join" not in plan.toString():
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer single text is a run of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Give memory that a worker has freed back to the system; workers live on between groups."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held_out(doc_id="doc_id", remainder: int = 0):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == remainder


def ragged_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length) in turn."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
