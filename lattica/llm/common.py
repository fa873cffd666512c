"""Helpers shared by the corpus operators: tables, shared-folder cuts, word hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop, release, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers BATCH_ROWS at a time, unless the session asks for fewer: a
    worker's memory then doesn't follow the size of a partition. Results don't depend on it."""
    if int(spark.conf.get(BATCH_KEY, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Collect each executor's JVM in full, which returns the unused part of its heap to the system: a heap that has grown
    in one stage stays as large in the next, beside what that one's Python workers take. One short task an executor; where a
    task misses one, that heap stays as it is, and no result depends on it."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()  # the driver is counted too
    spark.range(0, executors, 1, executors).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def remainder(column: str, n: int):
    """crc32(column as text) mod n, the split that the contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class WordHash(dict):
    """Word bytes -> 64-bit hash, cached; emptied before it grows past `limit` words."""

    limit = 60_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` words, in order. Fewer words than that
    make one shingle of all of them; no words make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix((out ^ hashes[i : n - k + 1 + i]) * _MULT[i % len(_MULT)])
    return out


def to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
