"""Helpers the training-data operators share: sessions, tables, scratch space, hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch

#: Rows of an Arrow batch.  Texts may be long, so batches are kept short; a Python worker
#: then holds a few megabytes of text at a time whatever the size of the table.
BATCH_ROWS = 512

#: What operators keep in this Python worker from task to task: how to drop it, by operator.
_KEPT: dict[str, Callable[[], object]] = {}

_U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that this session sends to Python workers, and let shuffle files go
    as soon as their query has ended: operators hand on tables in the shared folder, not shuffles."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage durably.

    The copy outlives lost executors and is removed by release() or when the driver ends.
    """
    return scratch.keep(df, label, **options)


def release(*tables: DataFrame) -> None:
    """Remove materialised tables whose last reader has been written."""
    scratch.release(*tables)


def begin(operator: str, forget: Callable[[], object] | None = None) -> None:
    """A task of an operator begins in this Python worker: what others have kept here goes, since
    one stage after the other runs in the same workers and their memory would add up.

    forget drops what the operator itself keeps for its next tasks.
    """
    others = [k for k in _KEPT if k != operator]
    for k in others:
        _KEPT.pop(k)()
    if forget:
        _KEPT[operator] = forget
    if others:  # freed memory goes back to the system, not only to the allocators
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [v or b"" for v in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed shifts and multipliers of the public SplitMix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))
