"""A table of hashed counts over all rows, of a size that does not depend on the data.

Each task counts its own hashes into one array and emits it in slices; slices are summed in a stream,
so no task holds more than the table itself. The table only orders or filters hashes ahead of an exact
join: collisions cost time, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.common import mapped

#: log2 of the number of counters; as one byte each they are a broadcast of 4 MB.
BITS = 22
_SLICES = 64


def slots(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def counted(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> np.ndarray:
    """How many of the hashes that `hashes` yields for df's Arrow batches fall to each of 2**bits counters."""
    size = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(1 << bits, np.uint32), False
        for batch in batches:
            for h in hashes(batch):
                any_row = True
                np.add.at(total, slots(h, bits), np.uint32(1))
        if any_row:
            # Two bytes a counter: what is over goes into further rows of the same slice.
            for k in range(_SLICES):
                left = total[k * size : (k + 1) * size]
                while left.any():
                    part = np.minimum(left, 2**16 - 1)
                    left = left - part
                    yield _row(k, part.astype(np.uint16))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(part, np.uint16 if len(part) == 2 * size else np.uint32).astype(np.int64)
        for k, part in total.items():
            yield _row(k, np.minimum(part, 2**32 - 1).astype(np.uint32))

    schema = "slice int, counts binary"
    rows = mapped(mapped(df, count, schema).repartition(min(16, _SLICES), "slice"), add, schema)
    table = np.zeros(1 << bits, np.int64)
    for r in rows.collect():  # at most 64 rows of a fixed size
        table[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], np.uint32)
    return table


def _row(k: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])
