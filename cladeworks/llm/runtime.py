"""Shared helpers of the text operators: table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import weakref
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass handles; it bounds a worker's memory.
BLOCK_BYTES = 1 << 21
#: Rows of an Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_session(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts; a session that asks for smaller ones keeps them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error,
    for no machine-local folder would be seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not named:
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="cladeworks-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions and their row order stay as they are; lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back; columnar and compressed.

    The shuffle files that made it are removed at once, so that a chain of steps holds one step's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cladeworks-{uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = weakref.ref(out), path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for df in tables:
        ref, path = _paths.pop(id(df), (lambda: None, ""))
        if ref() is df:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, end to end, and its len + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """Return memory that earlier tasks of this worker have freed: allocators keep it, and an executor's workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part's texts have at most ``limit`` bytes (one longer text stays whole)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start, batch.num_rows - start)
        del batch  # else it stays until the next one is here
    give_back()  # an idle worker keeps what its last task has freed
