"""From a folder of archives to findings and reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.limits import Limits
from sieveline.operators.capping import first_rows
from sieveline.plans import rules
from sieveline.plans.job import Cancelled, Job
from sieveline.sources import archives, descriptors
from sieveline.sources.hash_list import SCHEMA, file_system

#: Entries of a node that cannot be read and are named one by one.
SHOWN_ERRORS = 20
FINDINGS = "archive_id string, node_path string, rule_order int, rule_id string, seq long, severity string, confidence string, title string, location string, context string, is_rest boolean, explanation string, rationale string"


@dataclass
class Tables:
    files: DataFrame
    nodes: DataFrame
    entries: DataFrame
    classes: DataFrame
    mods: DataFrame
    manifest: DataFrame
    folder: str
    #: (family, message) of the rules that failed when findings_of ran.
    rule_errors: list[tuple[str, str]] = field(default_factory=list)

    @property
    def loaders(self) -> DataFrame:
        """node, loader of each archive."""
        return descriptors.loaders(self.nodes, self.mods, self.manifest, self.classes)

    @property
    def errors(self) -> DataFrame:
        """node, stage, entry, message: what could not be opened, read or parsed; of a node's entries the first SHOWN_ERRORS that could not be read."""
        read = self.nodes.sparkSession.read.parquet(f"{self.folder}/read")
        row = lambda stage, entry, message: [*rules.NODE, F.lit(stage).alias("stage"), entry.alias("entry"), message.alias("message")]
        said = F.when(F.col("status") == "failed", "not a readable class").otherwise("not read")
        return (
            self.nodes.filter("not valid").select(*row("open", F.lit(""), F.col("message")))
            .unionByName(first_rows(self.entries.filter("message is not null"), rules.NODE, ["entry_seq"], SHOWN_ERRORS).select(*row("contents", F.col("name"), F.col("message"))))
            .unionByName(read.filter("kind = 'error'").select(*row("open", F.lit(""), F.col("message"))))
            .unionByName(self.classes.filter("status <> 'parsed'").select(*row("classes", F.col("entry_name"), said)))
            .unionByName(descriptors.unreadable(read).select(*row("metadata", F.col("name"), F.lit("cannot be parsed"))))
        )

    def discard(self) -> None:
        """Deletes what was staged for these tables and their findings, when nothing reads them any more."""
        fs, at = file_system(self.nodes.sparkSession, self.folder)
        fs.delete(at, True)


def staging_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps shared data; a folder of our own only in local mode, where none need be named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sieveline-")
    return f"{root}/triage-{uuid.uuid4().hex}"


def decoded(files: DataFrame, limits: Limits = Limits(), folder: str | None = None, job: Job | None = None) -> Tables:
    """Tables of files (archive_id, file_name, content, …). Reading runs once, into Parquet that all tables are views of. job: to watch and stop it."""
    spark = files.sparkSession
    job = job or Job(spark)
    folder = folder or staging_folder(spark)
    files = archives.described(files)
    kind = F.col("kind")
    job.written(archives.read_archives(files, limits), f"{folder}/read", "read", files=F.count_if((kind == "node") & (F.col("node_path") == "")), nodes=F.count_if(kind == "node"), entries=F.count_if(kind == "entry"), refused=F.count_if((kind == "node") & F.col("message").isNotNull()))
    read = spark.read.parquet(f"{folder}/read")
    job.written(archives.classes(read), f"{folder}/classes", "classes", parsed=F.count_if(F.col("status") == "parsed"))
    manifest = descriptors.manifest(read)
    return Tables(files, archives.nodes(read), archives.entries(read), spark.read.parquet(f"{folder}/classes"), descriptors.with_versions(descriptors.mods(read), manifest), manifest, folder)


def findings_of(t: Tables, hashes: DataFrame | None = None, limits: Limits = Limits(), only: list[str] | None = None, job: Job | None = None) -> DataFrame:
    """Findings of all files, those of archives inside at their file, and those between files. only: families of rules (plans.rules.RULES, "batch") to plan, all if it is not given.

    A family that fails is told in t.rule_errors, and in reports. A job that is cancelled raises Cancelled: there are all findings or none.
    """
    spark = t.nodes.sparkSession
    job = job or Job(spark)
    hashes = spark.createDataFrame([], SCHEMA) if hashes is None else hashes
    step = f"{t.folder}/{uuid.uuid4().hex}"

    def once(df: DataFrame, name: str) -> DataFrame:
        """df computed once for the many rules that read it."""
        job.written(df, f"{step}/{name}", name)
        return spark.read.schema(df.schema).parquet(f"{step}/{name}")

    mods = once(t.mods, "mods")
    subjects = rules.Subjects(t.nodes, t.entries, t.classes, mods, t.manifest, hashes.select("sha256", "classification"), limits, once)
    own, t.rule_errors = rules.all_findings(subjects, None if only is None else [x for x in only if x != "batch"])
    found = rules.rolled_up_nodes(own)
    return found.unionByName(rules.batch_rules(mods), allowMissingColumns=True) if only is None or "batch" in only else found


def triage(spark: SparkSession, paths: str | list[str], hashes: DataFrame | None = None, recursive: bool = True, limits: Limits = Limits(), job: Job | None = None) -> tuple[Tables, DataFrame]:
    """Tables and findings of a folder, or of several files and folders.

    If job is cancelled once the files are read, there are tables, no finding, and an error that says so; before, Cancelled is raised.
    """
    files = archives.scan(spark, paths, recursive) if isinstance(paths, str) else archives.scan_paths(spark, paths, recursive)
    t = decoded(files, limits, job=job)
    try:
        return t, findings_of(t, hashes, limits, job=job)
    except Cancelled as e:
        t.rule_errors = [("cancelled", str(e))]
        return t, spark.createDataFrame([], FINDINGS)
