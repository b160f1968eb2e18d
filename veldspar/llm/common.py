"""What the operators of this subpackage share: reading, durable tables, small Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: Rows and bytes in one Arrow batch. Texts may be long, so both are smaller than Spark's defaults of 10,000 and 64 MB.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, whose queries and pipeline stages run in a few gigabytes.

    Operators used on their own take batches of any size; Spark bounds their bytes too.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files that all can read.

    The shuffle files that the write needed go with its end. The path is kept as ``durable_path``, for ``discard``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a durable table that nothing will read again."""
    _remove(df.sparkSession, df.durable_path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Durable tables made within go at its end, but for what the given function is called with.

    Only tables that are durable themselves may be kept; anything derived lazily from one that goes is lost.
    """
    held: list[str] = []
    token = _SCRATCH.set(held)

    def keep(df: DataFrame) -> DataFrame:
        """df: the durable table made last."""
        kept.append(held[-1])
        return df

    kept: list[str] = []
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in held:
            if path not in kept:
                _remove(spark, path)
        if (outer := _SCRATCH.get()) is not None:
            outer += kept


_CACHES: dict[str, dict] = {}
_ENTERED = [""]


def cache(name: str) -> dict:
    """What a Python worker keeps between tasks for one operator."""
    return _CACHES.setdefault(name, {})


def enter(name: str) -> None:
    """To be called where a task of an operator begins: a worker that served another gives its memory back."""
    if _ENTERED[0] == name:
        return
    _ENTERED[0] = name
    for other, kept in _CACHES.items():
        if other != name:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64 bits that tell rows apart even where ids repeat or are null; equal rows share it. Joins of operators that
    can carry the id use both."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_values(col) -> list[bytes]:
    """The values of a string column as UTF-8, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
