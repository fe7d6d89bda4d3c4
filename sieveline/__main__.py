"""Triage of archive files and folders of them: python -m sieveline PATH... [-r] [--hashes FILE] [--json PATH] [--txt PATH] [--parquet PATH] [-q]

Exit code 0 when all paths were triaged, whatever the findings; 1 when a path is not there or no archive was found. Messages go to stderr, the text report to stdout.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sieveline import __doc__ as about
from sieveline.plans.triage import triage
from sieveline.sources.hash_list import read_hash_list
from sieveline.sources.reports import as_text, documents, write_report


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline", description=about)
    p.add_argument("paths", nargs="+", help="archive files and folders of them")
    p.add_argument("-r", "--recursive", action="store_true", help="also folders within folders")
    p.add_argument("--hashes", metavar="FILE", help="list of known files")
    for kind in ("json", "txt", "parquet"):
        p.add_argument(f"--{kind}", metavar="PATH", help=f"write a {kind} report; an existing path is refused")
    p.add_argument("-q", "--quiet", action="store_true", help="do not print the report")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(args)
    tell = lambda text: print(text, file=sys.stderr)
    if hasattr(sys.stdout, "reconfigure"):
        sys.stdout.reconfigure(errors="replace")  # a console that lacks a letter prints a stand-in
    spark = spark or SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    hashes = None
    if a.hashes:
        try:
            hashes, rejected = read_hash_list(spark, a.hashes)
            for row in rejected.limit(20).toLocalIterator():
                tell(f"hash list: {row.reason}")
            hashes.head(1)
        except Exception as e:  # a list that cannot be read costs its verdicts, not the triage
            tell(f"the hash list cannot be read and is left out: {type(e).__name__}")
            hashes = None
    try:
        tables, findings = triage(spark, a.paths, hashes, a.recursive)
    except FileNotFoundError as e:
        tell(f"not found: {e}")
        return 1
    if not tables.nodes.head(1):
        tell("no archives found")
        return 1
    for _, message in tables.rule_errors:
        tell(message)
    reports = documents(tables.files, findings, tables, hashes)
    if not a.quiet:
        for row in as_text(reports).orderBy("archive_id").toLocalIterator():
            print(row.value, end="\n\n")
    for kind in ("json", "txt", "parquet"):
        if path := getattr(a, kind):
            write_report(reports, path, kind)
            tell(f"wrote {kind}: {path}")
    tables.discard()
    return 0


if __name__ == "__main__":
    sys.exit(main())
