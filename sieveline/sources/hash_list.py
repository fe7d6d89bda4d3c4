"""The list of known files: a JSON document {schema_version: 1, entries: {sha256: {classification, name, version, source, notes, added}}}."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import normalized_sha256

CLASSIFICATIONS = ["VERIFIED", "UNKNOWN", "SUSPICIOUS"]
FIELDS = ["name", "version", "source", "notes", "added"]
SCHEMA = "sha256 string, classification string, " + ", ".join(f"{f} string" for f in FIELDS)


def read_hash_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason). A document of another schema version, or that is no JSON, has one rejected row and nothing else."""
    text = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    doc = text.withColumn("v", F.try_parse_json("value")).withColumn("version", F.try_variant_get("v", "$.schema_version", "int"))
    entries = F.coalesce(F.try_variant_get("v", "$.entries", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = doc.filter("version = 1").select(F.explode(entries).alias("key", "e"))
    field = lambda name: F.try_variant_get("e", f"$.{name}", "string").alias(name)
    rows = rows.select("key", normalized_sha256(F.col("key")).alias("sha256"), F.upper(F.try_variant_get("e", "$.classification", "string")).alias("classification"), *map(field, FIELDS))
    good = F.col("sha256").isNotNull() & F.coalesce(F.col("classification").isin(CLASSIFICATIONS), F.lit(False))
    reason = F.when(F.col("sha256").isNull(), "not a SHA-256").otherwise("no such classification")
    rejected = rows.filter(~good).select("key", reason.alias("reason"))
    broken = doc.filter("coalesce(version, 0) <> 1").select(F.lit("").alias("key"), F.lit("not a hash list of version 1").alias("reason"))
    # Keys that differ in case alone are one file; the last by key counts.
    valid = rows.filter(good).groupBy("sha256").agg(F.max_by(F.struct("classification", *FIELDS), "key").alias("r")).select("sha256", "r.*")
    return valid, rejected.unionByName(broken)


def upserted(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """hashes with new's rows in place of those of the same file."""
    return hashes.join(new.select("sha256"), "sha256", "left_anti").unionByName(new, allowMissingColumns=True)


def removed(hashes: DataFrame, sha256: str) -> DataFrame:
    return hashes.filter(F.col("sha256") != sha256.strip().lower())


def as_document(hashes: DataFrame) -> DataFrame:
    """The list as one JSON text, keys in order. The list is a small dimension; for large ones write `hashes` as Parquet."""
    entry = F.struct("classification", *FIELDS)
    pairs = F.sort_array(F.collect_list(F.struct("sha256", entry.alias("e"))))
    return hashes.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.map_from_entries(pairs).alias("entries"))).alias("value"))


# --- Versions ---------------------------------------------------------------------------------------
#
# A list that is kept is a folder of versions v00000001, v00000002, … in Parquet. A new one is written beside them under a name of its own and renamed: a reader sees
# all of it or none. Two writers cannot both give it the same number; the one that comes second is told.

_VERSION = "v{:08d}"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions at path, ascending."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def opened(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a list at path: a .json document, or the newest of its versions, or the one asked for. A list that is not there is empty; ValueError for a document that is none."""
    none = spark.createDataFrame([], "key string, reason string")
    fs, at = file_system(spark, path)
    if path.lower().endswith(".json"):
        if not fs.exists(at):
            return spark.createDataFrame([], SCHEMA), none
        valid, rejected = read_hash_list(spark, path)
        if rejected.filter("key = ''").head(1):
            raise ValueError(f"{path}: not a hash list of version 1")
        return valid, rejected
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], SCHEMA), none
    return spark.read.schema(SCHEMA).parquet(f"{path}/{_VERSION.format(found[-1] if version is None else version)}"), none


def saved(hashes: DataFrame, path: str) -> str:
    """Writes the list: a further version of a folder, or a .json document in place of the one that is there. Gives the path of what was written; FileExistsError if another writer came first."""
    spark = hashes.sparkSession
    fs, at = file_system(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.new" if path.lower().endswith(".json") else f"{path}/_new-{uuid.uuid4().hex}"
    temporary = spark._jvm.org.apache.hadoop.fs.Path(beside)
    rows = hashes.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    try:
        if path.lower().endswith(".json"):
            as_document(rows).coalesce(1).write.text(beside)
            part = next(f.getPath() for f in fs.listStatus(temporary) if f.getPath().getName().startswith("part-"))
            final = fs.makeQualified(at)
            replaced = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
            options = spark._jvm.org.apache.hadoop.fs.Options.Rename
            chosen = spark.sparkContext._gateway.new_array(options, 1)
            chosen[0] = options.OVERWRITE
            replaced.rename(fs.makeQualified(part), final, chosen)
            if final.toUri().getScheme() == "file":  # without the checksum beside it, the document may be edited by hand
                fs.getRawFileSystem().delete(spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.crc"), False)
            return path
        number = max(versions(spark, path), default=0) + 1
        rows.write.parquet(beside)
        target = f"{path}/{_VERSION.format(number)}"
        final = spark._jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(final) or not fs.rename(temporary, final):
            raise FileExistsError(target)
        return target
    finally:
        if fs.exists(temporary):
            fs.delete(temporary, True)
