"""What archives consist of, as tables: counters, histograms, first projects, bindings. Rows are aggregated by node; nothing is gathered but lists of a stated length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.capping import first_rows

NODE = ["archive_id", "node_path"]
#: Binding names that a class lists at most.
BINDINGS = 10


def counters(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """A row a node that has entries: entries, files, directories, declared_bytes, compressed_bytes, unread (entries that cannot be read), and classes by status."""
    own = entries.groupBy(*NODE).agg(
        F.count("*").alias("entries"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"), F.sum("size_bytes").alias("declared_bytes"),
        F.sum("compressed_bytes").alias("compressed_bytes"), F.count_if(F.col("message").isNotNull()).alias("unread"),
    )
    by_status = classes.groupBy(*NODE).agg(F.count("*").alias("classes"), *[F.count_if(F.col("status") == s).alias(s) for s in ("parsed", "failed", "skipped")])
    return own.join(by_status, NODE, "left").fillna(0, ["classes", "parsed", "failed", "skipped"])


def _counted(rows: DataFrame, value: str) -> DataFrame:
    """node, value, n and the first entry that has it."""
    return rows.groupBy(*NODE, value).agg(F.count("*").alias("n"), F.min("entry_seq").alias("first_seq"))


def extensions(entries: DataFrame) -> DataFrame:
    """node, extension, n, first_seq of files; (none) for those without an extension."""
    ext = T.extension_of(F.col("name"))
    return _counted(entries.filter("not is_dir").select(*NODE, "entry_seq", F.when(ext == "", "(none)").otherwise(ext).alias("extension")), "extension")


def java_versions(classes: DataFrame) -> DataFrame:
    """node, java_version, n, first_seq of parsed classes."""
    return _counted(classes.filter("status = 'parsed'").select(*NODE, "entry_seq", T.java_version_label(F.col("major_version")).alias("java_version")), "java_version")


def packages(classes: DataFrame) -> DataFrame:
    """node, package (its first two names), n, first_seq of parsed classes."""
    return _counted(classes.filter("status = 'parsed'").select(*NODE, "entry_seq", T.top_package(F.col("name")).alias("package")), "package")


def primary_projects(mods: DataFrame) -> DataFrame:
    """The first declared project of each file itself, not of archives inside: by order of descriptors, then as declared."""
    own = mods.filter("node_path = ''")
    return own.groupBy("archive_id").agg(F.min_by(F.struct(*[c for c in own.columns if c not in NODE]), F.struct("source_order", "mod_seq")).alias("m")).select("archive_id", "m.*")


def bindings(evidence: DataFrame) -> DataFrame:
    """node, entry_name, bindings: of classes that load native code the platform bindings that they name, without packages and inner classes, BINDINGS at most in order of name."""
    of_platform = F.filter("class_refs", lambda r: r.startswith("com/sun/jna/platform/"))
    names = F.array_sort(F.array_distinct(F.transform(of_platform, lambda r: T.simple_name(r))))
    return evidence.filter(F.array_contains("tags", "native_loading")).select(*NODE, "entry_name", F.slice(names, 1, BINDINGS).alias("bindings"))


def top(counted: DataFrame, value: str, most: int) -> DataFrame:
    """archive_id, values: the most frequent of a file's own values as (value, n), ties as first seen, `most` of them."""
    first = first_rows(counted.filter("node_path = ''"), ["archive_id"], [F.desc("n"), "first_seq"], most)
    return first.groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.col(value).alias("value"), "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("values"))
