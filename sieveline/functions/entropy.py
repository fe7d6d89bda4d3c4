"""Entropy of texts of any length, one pass each: code points are counted in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bits(text: str | None) -> float | None:
    if not text:
        return None if text is None else 0.0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
    share = counts[counts > 0] / len(points)
    return float(-(share * np.log2(share)).sum()) + 0.0


@F.arrow_udf(T.DoubleType())
def text_entropy(text: pa.Array) -> pa.Array:
    """Bits per character (code point); 0 for empty text, null for null."""
    return pa.array([_bits(t.as_py()) for t in text], pa.float64())
