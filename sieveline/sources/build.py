"""Archives built from rows: each text's words become the literals of a class file, a few texts an archive.

The counterpart of reading, for round trips: what the decoded tables say must equal what the texts say.
"""

from __future__ import annotations

import hashlib
import io
import struct
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.batches import bounded, mapped

#: Literals of a class (its pool holds 65,534 constants, two for each literal), and texts of an archive.
LITERALS, TEXTS = 30_000, 64
#: Characters of a literal, which holds 65,535 bytes.
PIECE = 16_000
_OF_NUMBERS = frozenset("0123456789.")
FILES = "archive_id string, file_name string, size_bytes long, content binary"


def literal_class(name: str, literals: list[str]) -> bytes:
    """A class file that has nothing but its name and literals of at most 65,535 bytes each."""
    utf8 = lambda raw: b"\x01" + struct.pack(">H", len(raw)) + raw
    pool = [utf8(name.encode()), b"\x07" + struct.pack(">H", 1)]
    for text in literals:
        pool.append(utf8(text.encode("utf-8", "replace")))
        pool.append(b"\x08" + struct.pack(">H", len(pool)))
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 61, len(pool) + 1) + b"".join(pool) + struct.pack(">HHH", 33, 2, 0) + bytes(8)


def pieces(word: str) -> list[str]:
    """A word as literals of at most PIECE characters. It is cut between two signs that no number with dots has, so that addresses stay whole and none comes into being; only a longer run of digits and dots is cut within."""
    out, start = [], 0
    while len(word) - start > PIECE:
        end = start + PIECE
        while end > start + 1 and (word[end] in _OF_NUMBERS or word[end - 1] in _OF_NUMBERS):
            end -= 1
        end = end if end > start + 1 else start + PIECE
        out.append(word[start:end])
        start = end
    return [*out, word[start:]]


def archives_of(entries: DataFrame) -> DataFrame:
    """FILES: an archive for each archive_id of rows (archive_id, seq, name, content binary), its entries deflated in order of seq. An archive is built in one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("seq", "name", "content")]), key=lambda r: r[:2])
        out = io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            warnings.simplefilter("ignore")  # names may repeat
            for _, name, content in rows:
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
        name, data = table.column("archive_id")[0].as_py(), out.getvalue()
        return pa.table({"archive_id": [name], "file_name": [name], "size_bytes": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    bounded(entries.sparkSession)
    return entries.select("archive_id", F.col("seq").cast("long").alias("seq"), "name", "content").groupBy("archive_id").applyInArrow(run, FILES)


def packed(documents: DataFrame) -> DataFrame:
    """FILES: archives of documents' (doc_id, text) distinct words, at most TEXTS documents each. Classes are named d/<doc_id>_<part>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                rows = list(zip(some.column(0).to_pylist(), some.column(1).to_pylist()))
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for doc_id, text in rows:
                        words = [p for w in dict.fromkeys((text or "").split()) for p in pieces(w)]
                        for part in range(0, max(1, len(words)), LITERALS):
                            name = f"d/{doc_id}_{part}"
                            z.writestr(zipfile.ZipInfo(f"{name}.class", (2024, 1, 1, 0, 0, 0)), literal_class(name, words[part : part + LITERALS]), zipfile.ZIP_DEFLATED)
                # Batches that begin with the same doc_id are told apart by what they hold.
                data = out.getvalue()
                name = f"texts-{rows[0][0]}-{hashlib.sha256(data).hexdigest()[:16]}.jar"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["archive_id", "file_name", "size_bytes", "content"])

    return mapped(documents.select("doc_id", F.col("text").cast("string").alias("text")), run, FILES)
