"""What the operators of this subpackage share: tables, scratch space, size-checked joins, Arrow text."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.batches import BATCH_BYTES, BATCH_ROWS, bounded, mapped, releasing  # noqa: F401

#: Rows of an id-only side that may be broadcast (16 MB of longs); above it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bytes of text that a Python task works on at a time.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode, where none need be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and columns that are not asked for are not read.

    Unlike a checkpoint's, the new plan's size is that of its files: joins in a loop neither multiply estimates nor miss a
    broadcast. The files go with discard(), or when the driver ends.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, df.sparkSession, path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in dfs:
        removed(df.sparkSession, df.staged_at)


def removed(spark: SparkSession, path: str) -> None:
    """The files under path deleted, if they and the session's JVM are still there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):
        pass  # the JVM has ended first


def keep_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", rows: int | None = None) -> DataFrame:
    """Semi or anti join on id columns. ids is broadcast only when its counted rows are within BROADCAST_IDS."""
    rows = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, key, how)


def fold(column: str = "doc_id"):
    """crc32 of the id's decimal text modulo 3; rows where it is 1 are held out of every training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of an Arrow string column without copying; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `most` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def ints(column: pa.Array) -> np.ndarray:
    """An Arrow integer column as int64; null becomes the smallest long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
