"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice have at most ``limit`` bytes, or one row.

    Arrow batches are bounded in rows, not in bytes; work on slices keeps the
    memory of a Python worker flat when texts are long.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first)


def give_back_memory() -> None:
    """Return freed memory to the machine: reused Python workers would keep it from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass
