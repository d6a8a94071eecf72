"""Shared pieces: written intermediate tables, packed rows for shuffles, byte hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import own_folder

U64 = np.uint64
#: An odd multiplier of a polynomial over bytes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    The files outlive lost executors and go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch where whole texts go through Python.
TEXTS_PER_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small: with the usual number of rows, long texts fill a task's memory.

    The setting is read when a plan runs, which may be after an operator returns, so it stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes batches on, giving back what Arrow's pool keeps of each, as workers live on between tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


#: Bytes of input for one bucket of packed rows, at most.
BUCKET_BYTES = 8 << 20


def input_bytes(df: DataFrame) -> int:
    """What the tables below df take in all, as far as Spark knows; 0 where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def buckets(spark: SparkSession, per_partition: int = 4, df: DataFrame | None = None) -> int:
    """How many buckets packed rows are dealt to: several for each shuffle partition, and with df as many as its size asks for.

    A task holds one bucket at a time, so memory stays bounded even where spark.sql.shuffle.partitions is too low.
    """
    return max(per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // BUCKET_BYTES if df is not None else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16) * 5 // 4, base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (data[k] + 1) * BASE^k for i <= k < j, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that depends on the bytes alone, not on their place."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
