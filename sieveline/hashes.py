"""Keeps a list of known files: python -m sieveline.hashes LIST (--add FILE... | --sha256 HEX | --remove HEX | --list) [--classification C] [--name …] [--version …] [--source …] [--notes …]

LIST is a folder of versions (a table that grows), or a .json document. Readers see a whole version or the one before. Exit code 1 when there is nothing to
remove, a file is not there, or a value is no SHA-256.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import normalized_sha256
from sieveline.plans.inventory import primary_projects
from sieveline.plans.triage import decoded
from sieveline.sources import hash_list as H
from sieveline.sources.archives import scan_paths


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline.hashes", description=__doc__)
    p.add_argument("list_", metavar="LIST")
    p.add_argument("--add", nargs="+", default=[], metavar="FILE", help="files to hash and add")
    p.add_argument("--sha256", help="a hash to add")
    p.add_argument("--remove", metavar="HEX")
    p.add_argument("--list", action="store_true")
    p.add_argument("--classification", type=str.upper, choices=H.CLASSIFICATIONS)
    for name in ("name", "version", "source", "notes"):
        p.add_argument(f"--{name}")
    return p


def of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sha256, name, version of files: as the first project that each declares says, else by its file name and the manifest."""
    t = decoded(scan_paths(spark, paths))
    first = primary_projects(t.mods).select("archive_id", F.coalesce("mod_name", "mod_id").alias("declared"), F.col("version").alias("of_project"))
    built = t.manifest.filter("node_path = '' and key = 'Implementation-Version'").select("archive_id", F.col("value").alias("built"))
    rows = t.files.drop("content").join(first, "archive_id", "left").join(built, "archive_id", "left")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return rows.select("sha256", F.coalesce("declared", stem).alias("name"), F.when(F.col("declared").isNotNull(), F.col("of_project")).otherwise(F.col("built")).alias("version"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = arguments()
    a = p.parse_args(args)
    tell = lambda text: print(text, file=sys.stderr)
    spark = spark or SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        hashes, rejected = H.opened(spark, a.list_)
    except ValueError as e:
        tell(str(e))
        return 1
    for row in rejected.limit(20).toLocalIterator():
        tell(f"{row.key}: {row.reason}")
    if a.list:
        n = 0
        for r in hashes.orderBy("sha256").toLocalIterator():
            n += 1
            print(f"{r.sha256}  {r.classification:<10}  {r.name or ''} {r.version or ''}".rstrip())
        print(f"{n} entries")
        return 0
    if a.remove:
        kept = H.removed(hashes, a.remove)
        if kept.count() == hashes.count():
            tell("no such entry")
            return 1
        H.saved(kept, a.list_)
        return 0
    if not a.classification or not (a.add or a.sha256):
        p.error("name files or --sha256, and --classification")
    parts = []
    if a.sha256:
        sha = spark.range(1).select(normalized_sha256(F.lit(a.sha256)).alias("sha")).first().sha
        if sha is None:
            tell(f"not a SHA-256: {a.sha256}")
            return 1
        parts.append(spark.createDataFrame([(sha, a.name, a.version)], "sha256 string, name string, version string"))
    if a.add:
        try:
            parts.append(of_files(spark, a.add))
        except FileNotFoundError as e:
            tell(f"not a file: {e}")
            return 1
    new = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    text = lambda given, own: F.lit(given) if given is not None else own
    new = new.select("sha256", F.lit(a.classification).alias("classification"), text(a.name, F.col("name")).alias("name"), text(a.version, F.col("version")).alias("version"), F.lit(a.source).cast("string").alias("source"), F.lit(a.notes).cast("string").alias("notes"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("added"))
    H.saved(H.upserted(hashes, new.dropDuplicates(["sha256"])), a.list_)
    return 0


if __name__ == "__main__":
    sys.exit(main())
