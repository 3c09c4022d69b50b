"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.sources.shared import scratch

#: Odd multiplier of the polynomial word hashes, and the finaliser's constants (splitmix64).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on in this session: texts are long, and workers hold a batch several times."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give memory back.

    Arrow's allocator and the C library's keep what batches took, and executors keep idle workers: each would
    hold 100 MB and more until the application ends.
    """

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pool.release_unused()

        try:
            yield from run(read())
        finally:
            pool.release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return df.mapInArrow(freeing, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from; a null id counts as 0's text does: never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of all windows of ``size`` values, by doubling: O(n log size) steps."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = None, 0
    power, width, part = base, 1, values
    parts = []
    left = size
    while left:
        if left & 1:
            parts.append((part, width, power))
        left >>= 1
        if left:
            part = part[: len(part) - width] * power + part[width:]
            power, width = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), width * 2
    for part, width, power in reversed(parts):
        out = part[:n].copy() if out is None else out * power + part[done : done + n]
        done += width
    return mix(out)
