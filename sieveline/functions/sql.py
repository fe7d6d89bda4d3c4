"""Decoding for SQL: table functions over the bytes of a file, for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sieveline import refdata as R
from sieveline.limits import Limits
from sieveline.sources.archives import guarded

_ENTRY = [
    ("node_path", T.StringType()), ("entry_seq", T.LongType()), ("name", T.StringType()), ("is_dir", T.BooleanType()), ("size_bytes", T.LongType()),
    ("compressed_bytes", T.LongType()), ("flag_bits", T.IntegerType()), ("magic", T.StringType()), ("message", T.StringType()),
]


def _magic(head: bytes | None) -> str:
    """As functions.text.magic_of, of one entry; unknown where its first bytes were not read."""
    return "empty file" if head == b"" else next((name for prefix, name in R.MAGIC.items() if (head or b"")[:8].hex().upper().startswith(prefix)), "unknown")


class JarEntries:
    """jar_entries(content [, with_content]): the entries of an archive and of those inside it; a file that is none has no rows.

    with_content must be a constant: only if it is true there is a column content, with the bytes of those entries that are read whole (manifest, descriptors, classes).
    """

    def __init__(self) -> None:
        self.limits = Limits()

    @staticmethod
    def analyze(content: AnalyzeArgument, with_content: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, T.BinaryType):
            raise ValueError("jar_entries reads binary content")
        if with_content is not None and (not with_content.isConstantExpression or not isinstance(with_content.dataType, T.BooleanType)):
            raise ValueError("with_content is a constant, true or false")
        columns = [*_ENTRY, ("content", T.BinaryType())] if with_content is not None and with_content.value else _ENTRY
        return AnalyzeResult(schema=T.StructType([T.StructField(*c) for c in columns]))

    def eval(self, content: bytes | None, with_content: bool = False) -> Iterator[tuple]:
        for r in guarded("", bytes(content or b""), self.limits):
            if r["kind"] == "entry":
                row = (r["node_path"], r["entry_seq"], r["name"], r["is_dir"], r["size_bytes"], r["compressed_bytes"], r["flag_bits"], _magic(r["head"]), r["message"])
                yield (*row, r["content"]) if with_content else row


def register(spark: SparkSession) -> None:
    """Makes jar_entries known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("jar_entries", udtf(JarEntries))
