"""Archive files as tables: files -> nodes, entries and classes.

Reading inflates entries under one budget that a file and all archives inside it share, in the order of the
directory; that order decides what is read, so one file is one row of work. Everything after is independent:
classes are parsed one by one wherever Spark puts them, and descriptors are parsed by expressions.
Nothing is executed, extracted or changed. Bad input gives rows with a message, never a failed task.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.batches import mapped
from sieveline.functions.text import magic_of
from sieveline.limits import Limits

CHUNK = 64 * 1024
READ = """archive_id string, node_path string, depth int, kind string, entry_seq long, name string, is_dir boolean, size_bytes long,
compressed_bytes long, flag_bits int, head binary, content binary, sha256 string, message string"""
_NAMES = [c.split()[0] for c in READ.split(",")]
_ARROW = pa.schema([
    ("archive_id", pa.string()), ("node_path", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("entry_seq", pa.int64()), ("name", pa.string()), ("is_dir", pa.bool_()), ("size_bytes", pa.int64()),
    ("compressed_bytes", pa.int64()), ("flag_bits", pa.int32()), ("head", pa.binary()), ("content", pa.binary()), ("sha256", pa.string()), ("message", pa.string()),
])
_WANTED = {n.lower() for n in R.DESCRIPTORS} | {"meta-inf/manifest.mf"}


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.concat_ws("@", name, F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 8)).alias("archive_id"), name.alias("file_name"),
        F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"), "content",
    )


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Archive files of a folder: archive_id (file name and a hash of its path), size_bytes, modified, content."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][aA][rR]").option("recursiveFileLookup", str(recursive).lower()).load(folder))


def real_path(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(qualified path with links resolved where the file system is local, whether it is a folder); FileNotFoundError if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    full = fs.makeQualified(at)
    if full.toUri().getScheme() == "file":
        full = spark._jvm.org.apache.hadoop.fs.Path("file://" + os.path.realpath(full.toUri().getPath()))
    return full.toString(), fs.getFileStatus(full).isDirectory()


def scan_paths(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """Files of several paths as scan gives them: named files whatever their extension, and the archives of folders. A file that is reached twice, by links too, is read once.

    FileNotFoundError names a path that is not there. Paths are those that a caller lists, so they are sorted out on the driver; files of folders never are.
    """
    found = dict(real_path(spark, p) for p in paths)
    folders = [p for p, is_folder in found.items() if is_folder]
    within = lambda p, f: p.startswith(f.rstrip("/") + "/") and (recursive or "/" not in p[len(f.rstrip("/")) + 1 :])
    files = [p for p, is_folder in found.items() if not is_folder and not (p.lower().endswith(".jar") and any(within(p, f) for f in folders))]
    apart = [f for f in folders if not (recursive and any(f != g and within(f, g) for g in folders))]
    literal = lambda p: re.sub(r"([\\\[\]{}*?])", r"\\\1", p)  # noqa: E731  a name may hold signs that a path pattern gives a meaning to
    parts = [scan(spark, literal(f), recursive) for f in apart]
    if files:
        parts.append(_named(spark.read.format("binaryFile").load([literal(p) for p in files])))
    return reduce(DataFrame.unionByName, parts)


def described(files: DataFrame) -> DataFrame:
    """files with their type by first bytes and their SHA-256, also of files that are refused later."""
    kind = magic_of(F.col("content"), R.MAGIC)
    return files.withColumns({"file_type": kind, "sha256": F.sha2("content", 256), "is_archive": kind.startswith("ZIP/JAR")})


class _Refused(Exception):
    """An archive or entry that is not read, with the reason."""


class _Budget:
    def __init__(self, most: int):
        self.most, self.used = most, 0

    def take(self, n: int) -> None:
        self.used += n
        if self.used > self.most:
            raise _Refused("decompression budget is used up")


def _declared(data: bytes) -> tuple[int, int]:
    """Entries and directory bytes that the end record declares."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if at < 0 or len(data) - at < 22:
        raise _Refused("no end record")
    entries, size = struct.unpack_from("<HI", data, at + 10)
    if (entries == 0xFFFF or size == 0xFFFFFFFF) and at >= 20 and data[at - 20 : at - 16] == b"PK\x06\x07":
        wide = struct.unpack_from("<Q", data, at - 12)[0]
        if data[wide : wide + 4] != b"PK\x06\x06" or wide + 56 > len(data):
            raise _Refused("no wide end record")
        entries, size = struct.unpack_from("<QQ", data, wide + 32)
    return entries, size


def _opened(data: bytes, limits: Limits) -> zipfile.ZipFile:
    if len(data) > limits.max_archive_size:
        raise _Refused("archive is too large")
    if data[:2] != b"PK":
        raise _Refused("not an archive")
    entries, size = _declared(data)
    if entries > limits.max_entries or size > limits.max_entries * limits.directory_bytes_per_entry:
        raise _Refused("too many entries")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:  # untrusted bytes: whatever the reader raises is a reason to refuse them
        raise _Refused(f"damaged archive: {type(e).__name__}") from None
    if len(archive.infolist()) > limits.max_entries:
        raise _Refused("too many entries")
    return archive


def _inflated(archive: zipfile.ZipFile, info: zipfile.ZipInfo, budget: _Budget, most: int, whole: bool = True) -> bytes:
    """An entry's bytes (its first 8 if not whole). An entry over `most` costs no more than what was read before."""
    if info.flag_bits & 1:
        raise _Refused("entry is encrypted")
    parts, size = [], 0
    try:
        with archive.open(info) as stream:
            while part := stream.read(CHUNK if whole else 8 - size):
                size += len(part)
                if size > most:
                    raise _Refused("entry is too large")
                budget.take(len(part))
                parts.append(part)
                if not whole and size >= 8:
                    break
    except _Refused:
        raise
    except Exception as e:  # any decompressor's own errors too
        raise _Refused(f"unreadable entry: {type(e).__name__}") from None
    return b"".join(parts)


def _node(archive_id: str, path: str, depth: int, data: bytes, budget: _Budget, limits: Limits) -> Iterator[dict]:
    """Rows of one archive and those inside it: the node, its entries and messages."""
    of = {"archive_id": archive_id, "node_path": path, "depth": depth}
    node = of | {"kind": "node", "name": path.rpartition("!/")[2] or archive_id, "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    try:
        archive = _opened(data, limits)
    except _Refused as e:
        yield node | {"message": str(e)}
        return
    yield node
    infos = archive.infolist()
    first = {}
    for k, info in enumerate(infos):
        first.setdefault(info.filename, k)
    content: dict[int, bytes] = {}
    failed: dict[int, str] = {}

    def read(k: int, most: int, whole: bool = True) -> bytes | None:
        try:
            return _inflated(archive, infos[k], budget, most, whole)
        except _Refused as e:
            failed[k] = str(e)
            return None

    # In this order: manifest and descriptors, first bytes of files, classes, archives inside.
    wanted = [k for name, k in first.items() if name.lower() in _WANTED]
    order = ["meta-inf/manifest.mf", *[n.lower() for n in R.DESCRIPTORS]]
    for k in sorted(wanted, key=lambda k: order.index(infos[k].filename.lower())):
        if (data_ := read(k, limits.max_descriptor_size)) is not None:
            content[k] = data_
    heads = {k: read(k, 8, whole=False) for k, i in enumerate(infos) if not i.is_dir() and not i.filename.lower().endswith(".class") and i.file_size >= 4 and budget.used < budget.most}
    for k, info in enumerate(infos):
        if not info.is_dir() and info.filename.endswith(".class"):
            if budget.used >= budget.most:
                failed[k] = "skipped: decompression budget is used up"
            elif (data_ := read(k, limits.max_entry_size)) is not None:
                content[k] = data_
    for k, info in enumerate(infos):
        yield of | {
            "kind": "entry", "entry_seq": k, "name": info.filename, "is_dir": info.is_dir(), "size_bytes": info.file_size, "compressed_bytes": info.compress_size,
            "flag_bits": info.flag_bits, "head": heads.get(k), "content": content.pop(k, None), "message": failed.get(k),
        }
    for k, info in enumerate(infos):
        if not info.is_dir() and info.filename.lower().endswith(".jar"):
            inner = f"{path}!/{info.filename}" if path else info.filename
            if depth + 1 > limits.max_nesting_depth:
                yield of | {"kind": "node", "node_path": inner, "depth": depth + 1, "name": info.filename, "message": "nested too deep"}
            elif (data_ := read(k, limits.max_entry_size)) is None:
                yield of | {"kind": "node", "node_path": inner, "depth": depth + 1, "name": info.filename, "message": failed[k]}
            else:
                yield from _node(archive_id, inner, depth + 1, data_, budget, limits)


def guarded(archive_id: str, data: bytes, limits: Limits) -> Iterator[dict]:
    """Rows of a file. Should anything get past the checks, reading ends with a row of kind error: one file never fails the job."""
    try:
        yield from _node(archive_id, "", 0, data, _Budget(limits.max_total_decompressed), limits)
    except Exception as e:
        yield {"archive_id": archive_id, "node_path": "", "depth": 0, "kind": "error", "message": f"reading broke off: {type(e).__name__}"}


#: Bytes of entries that a task holds before it hands their rows on.
HELD_BYTES = 1 << 20


def read_archives(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of nodes and entries (READ) of files (archive_id, content). Use it staged: every view below filters it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                held = 0
                for row in guarded(archive_id, data.as_py() or b"", limits):
                    rows.append(row)
                    held += len(row.get("content") or b"") + 200
                    if held > HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return mapped(files.select("archive_id", "content"), run, READ)


def nodes(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'node'").select("archive_id", "node_path", "depth", "name", "size_bytes", "sha256", F.col("message").isNull().alias("valid"), "message")


def entries(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'entry'").select("archive_id", "node_path", "entry_seq", "name", "is_dir", "size_bytes", "compressed_bytes", "flag_bits", magic_of(F.col("head"), R.MAGIC).alias("magic"), "message")


# --- classes ----------------------------------------------------------------------------------------

#: Bytes after the tag of each kind of constant.
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
CLASS = "archive_id string, node_path string, entry_seq long, entry_name string, status string, name string, super_name string, major_version int, class_refs array<string>, member_refs array<string>, strings array<string>"


def class_file(data: bytes) -> dict:
    """Names, references and literals of a class file's constants; ValueError if it is none."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("wrong magic")
    try:
        major, count = struct.unpack_from(">HH", data, 6)
        at, tags, spots = 10, [0] * count, [0] * count
        k = 1
        while k < count:
            tag = data[at]
            tags[k], spots[k] = tag, at + 1
            at += 1 + (2 + struct.unpack_from(">H", data, at + 1)[0] if tag == 1 else _SIZES[tag])
            if at > len(data):
                raise ValueError("truncated")
            k += 2 if tag in (5, 6) else 1
        this, parent = struct.unpack_from(">HH", data, at + 2)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"not a class file: {type(e).__name__}") from None
    pair = lambda i: struct.unpack_from(">HH", data, spots[i])
    one = lambda i: struct.unpack_from(">H", data, spots[i])[0]
    is_a = lambda i, tag: 0 < i < count and tags[i] == tag

    def text(i: int) -> str | None:
        return data[spots[i] + 2 : spots[i] + 2 + one(i)].decode("utf-8", "replace") if is_a(i, 1) else None

    def class_name(i: int) -> str | None:
        return text(one(i)) if is_a(i, 7) else None

    def element(name: str) -> str:
        """The class of an array's elements; nothing for numbers."""
        bare = name.lstrip("[")
        return name if bare == name else bare[1:-1] if bare.startswith("L") and bare.endswith(";") else ""

    if not (name := class_name(this)):
        raise ValueError("no class name")
    refs = {element(n) for i in range(count) if (n := class_name(i))} - {""}
    members = set()
    for i in range(count):
        if tags[i] in (9, 10, 11):
            owner, call = pair(i)
            if (n := class_name(owner)) and is_a(call, 12) and (m := text(pair(call)[0])):
                members.add(f"{element(n)}#{m}")
    literals = [t for i in range(count) if tags[i] == 8 and (t := text(one(i))) is not None]
    return {"name": name, "super_name": class_name(parent), "major_version": major, "class_refs": sorted(refs), "member_refs": sorted(members), "strings": literals}


def classes(read: DataFrame) -> DataFrame:
    """A row for each *.class entry: status parsed, failed or skipped, and what its constants say. Parsed apart from reading, so a large archive's classes spread over tasks."""
    schema = pa.schema([("archive_id", pa.string()), ("node_path", pa.string()), ("entry_seq", pa.int64()), ("entry_name", pa.string()), ("status", pa.string()), ("name", pa.string()), ("super_name", pa.string()), ("major_version", pa.int32()), *[(c, pa.list_(pa.string())) for c in ("class_refs", "member_refs", "strings")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            # Row by row: the literals of a class take several times its bytes.
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                row = {k: r[k] for k in ("archive_id", "node_path", "entry_seq")} | {"entry_name": r["name"], "status": "skipped" if (r["message"] or "").startswith("skipped") else "failed"}
                if r["content"] is not None:
                    try:
                        row |= class_file(r["content"]) | {"status": "parsed"}
                    except Exception:  # untrusted bytes
                        pass
                rows.append(row)
                held += len(r["content"] or b"") + 200
                if held > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = read.filter("kind = 'entry' and not is_dir and endswith(name, '.class')").select("archive_id", "node_path", "entry_seq", "name", "message", "content")
    return mapped(found, run, CLASS)
