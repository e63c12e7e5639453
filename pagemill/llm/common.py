"""What the operators share: tables, written intermediates, text arrays, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import bound_batches, work_dir  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the files of a staged table that is no longer read."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which it does after a collection."""
    gc.collect()
    spark._jvm.System.gc()


def worker_cache(kind: str, key: str = "") -> dict:
    """A dict that the Python worker keeps from task to task; one in all, another kind or key empties it."""
    name = (kind, key)
    kept = sys.__dict__.setdefault("_pagemill_llm", {})
    if name not in kept:
        kept.clear()
        kept[name] = {}
    return kept[name]


class Shared:
    """A broadcast value of any class of this package; workers need no copy of the package to read it.

    A worker reads it once and keeps ``memo`` (a dict) beside it, until tasks that do not use the broadcast take its place.
    """

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def _kept(self) -> dict:
        return self.data.__dict__.setdefault("_pagemill_kept", {})

    @property
    def value(self):
        kept = self._kept()
        if "value" not in kept:
            kept["value"] = pickle.loads(self.data.value)
        return kept["value"]

    @property
    def memo(self) -> dict:
        return self._kept().setdefault("memo", {})


def give_back() -> None:
    """Return the memory that finished batches used, which the allocators of a Python worker would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def trimmed(step):
    """The ``mapInArrow`` function ``step``, which gives memory back after each batch that it yields."""
    def run(batches):
        for out in step(batches):
            yield out
            del out
            give_back()
    return run


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def list_array(sizes, values: pa.Array) -> pa.ListArray:
    """A list column from the length of each list and all values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


_SPLIT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (additions wrap)."""
    with np.errstate(over="ignore"):
        x = x + _SPLIT[0]
        x = (x ^ (x >> np.uint64(30))) * _SPLIT[1]
        x = (x ^ (x >> np.uint64(27))) * _SPLIT[2]
        return x ^ (x >> np.uint64(31))


#: A fixed random value for each byte, by rule.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0xD6E8FEB86659FD93, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(4096)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, at least ``n`` of them; only those of usual words are kept."""
    return _POWERS if n <= len(_POWERS) else _powers(n)


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each run of word bytes in ``data`` (is_word: a flag for each byte)."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word
    edge = np.diff(flags)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    where = np.flatnonzero(is_word)
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(len(where)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        value = BYTE_VALUES[data[where]] * powers(int(size.max()))[place]
        return mix64(np.add.reduceat(value, first) + size.astype(np.uint64)), starts
