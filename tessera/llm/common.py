"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, for bytes.translate.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is empty the session's own checkpoint directory is used. If there is none, a local session
    gets one under its warehouse; on a cluster that could be one machine's folder, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts get 1,000 rows and 8 MB at most, unless the session has set other limits: they lie outside the heap, once in the JVM and once in Python."""
    for key, default, small in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(64 << 20), str(8 << 20))):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, default).rstrip("bB") in (default, "67108864"):
            spark.conf.set(name, small)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage with files that outlive any executor.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memory(dict):
    """A cache of about most_bytes at most. What comes when it is full is worked out again each time, so the bound never changes a result."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.room = most_bytes

    def keep(self, key: str | bytes, value: object) -> None:
        size = 160 + 3 * len(key)  # the objects, their place in the table, the letters and what is kept of each
        if size <= self.room:
            self.room -= size
            self[key] = value


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """A Python worker's object for key, kept from task to task until another is asked for: a worker holds one operator's cache at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give memory that is no longer used back to the system; a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """A function for mapInArrow or applyInArrow that releases memory when it ends, and drops what other operators have kept, if it keeps nothing itself."""

    @wraps(run)
    def go(data):
        if not keeps:
            _KEPT.clear()
        try:
            out = run(data)
            return _released(out) if isinstance(out, Iterator) else out
        finally:
            release()

    return go


def _released(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        release()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df: for a file scan the size of its files.

    Plans it knows nothing about are counted, at 4 KB a row.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 4096 * df.count()


def parts_for(df: DataFrame, bytes_per_part: int, least: int = 8) -> int:
    """Partitions so that each gets about bytes_per_part of the files behind df."""
    return int(max(least, -(-input_bytes(df) // bytes_per_part)))


def rows_of(batch: pa.RecordBatch, at_once: int = 256) -> Iterator[tuple]:
    """The batch's rows as tuples, a few of them as Python objects at a time."""
    for lo in range(0, batch.num_rows, at_once):
        part = batch.slice(lo, at_once)
        yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the fold a label row belongs to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def ids_bytes(ids: list[int] | np.ndarray) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that df doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own += "_"
        out.append(own)
    return out
