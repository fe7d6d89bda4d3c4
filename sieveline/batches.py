"""What Python tasks hold, bounded: Arrow batches of rows and bytes, and what a worker keeps when a task is over."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch (one row at least).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: By module, how to drop what its tasks keep in a worker for further tasks.
KEPT: dict[str, Callable[[], None]] = {}


def let_go(module: str) -> None:
    """Drops what tasks of other modules have kept in this worker."""
    for name, drop in KEPT.items():
        if name != module:
            drop()


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with what executors hold for it bounded: Arrow batches of texts, and what a worker keeps between tasks."""
    bounded(df.sparkSession)
    return df.mapInArrow(releasing(f), schema)


def bounded(spark: SparkSession) -> None:
    """Sets BATCH_ROWS and BATCH_BYTES for the session's Arrow batches, unless they are smaller: whole texts would make the usual 10,000 rows a large buffer on both sides."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(name, most)


def releasing(f: Callable) -> Callable:
    """f, giving freed memory back to the system when a task is over; workers are kept for further tasks."""

    @functools.wraps(f)
    def run(batches):
        let_go(f.__module__)
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc
            trim(0)

    return run
