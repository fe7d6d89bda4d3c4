"""Archives that arrive in a folder, triaged as a stream: each file once, its findings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.limits import Limits
from sieveline.plans.rules import RULES, batch_rules
from sieveline.plans.triage import decoded, findings_of

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, hashes: DataFrame | None = None, limits: Limits = Limits(), once: bool = False) -> StreamingQuery:
    """Appends findings of new *.jar files to Parquet at out, a folder for each batch, so that a batch that is run again replaces its own.

    once: takes what is there and ends. The ids that files declare are kept at `{out}-ids`, a folder a batch: an id that earlier batches have too
    is told in the batch that brings it, at all its files. A batch that is run again reads only those before it and writes its own anew, so a restart changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.[jJ][aA][rR]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.concat_ws("@", name, F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 8)).alias("archive_id"), name.alias("file_name"), F.col("length").alias("size_bytes"), "content")

    def run(batch: DataFrame, number: int) -> None:
        t = decoded(batch, limits)
        found = findings_of(t, hashes, limits, only=[*RULES])
        own = t.mods.filter("node_path = '' and mod_id <> ''").select("archive_id", "node_path", "mod_id").distinct()
        own.write.mode("overwrite").parquet(f"{ids}/batch={number}")
        # Of the ids so far only those that this batch brings; its files are a bounded number.
        kept = spark.read.schema("archive_id string, node_path string, mod_id string, batch long").parquet(ids)
        brought = kept.filter(F.col("batch") == number).select(F.lower("mod_id").alias("id")).distinct()
        of_ids = kept.filter(F.col("batch") <= number).join(F.broadcast(brought), F.lower("mod_id") == F.col("id"), "left_semi")
        found = found.unionByName(batch_rules(of_ids), allowMissingColumns=True)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    ids = f"{out}-ids"
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
