"""Operator 10 [native]: exact deduplication by sorting content.

Normalised texts (A-Z lower-cased, null as empty) are range-partitioned by sampled splitters (over their
first characters and a hash, so that the sample is small) and sorted within their partitions by these and
by their whole content, so that equal texts are adjacent; neighbours are compared in full.

A text that many rows share would put all of them into one range. Rows are therefore counted by a hash of
the text first, and a text with more than 1/HOT of all rows (there are at most HOT of these) is
ranged with a salt as well: its rows sort into SALTS separate runs, whose short results (by SHA-256 of the text)
are joined afterwards.

Normalised texts are staged once with their hash, and so are the finished runs: counting, sampling and sorting
read what they need of these.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import staged

#: A text is hot with over 1/HOT of all rows, so at most HOT texts are hot, whatever the input.
HOT = 1000
#: Rows that a text has at least before it is hot.
LEAST = 100
#: Characters of a text that splitters are sampled from, next to its hash: what reaches the driver stays short.
LEAD = 24
#: Runs that a hot text's rows are dealt to.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def marked(documents: DataFrame, stays: str = "largest") -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (stays="smallest": the smallest). Rows that tie
    on that doc_id all count as kept; a null doc_id loses to any other, and a group of nothing else has a
    null keep_id and keeps its rows. Null and empty texts are one group; texts of any length are compared whole. An
    empty table gives an empty result; extra columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[stays]
    norm = normalised(F.col("text"))
    keyed = staged(documents.select("doc_id", norm.alias("norm")).select("*", F.xxhash64("norm").alias("h"), F.substring("norm", 1, LEAD).alias("lead")), "normalised")
    total = keyed.count()
    counts = keyed.groupBy("h").agg(F.count("*").alias("c"))
    hot = counts.filter(F.col("c") > max(LEAST, total // HOT)).select("h", F.lit(True).alias("is_hot"))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    dealt = keyed.join(F.broadcast(hot), "h", "left").withColumns({"is_hot": F.coalesce("is_hot", F.lit(False)), "salt": salt.cast("int")})
    # Range partitions by these already hold each run together: the window sorts and compares whole texts in place.
    run = Window.partitionBy("lead", "h", "norm", "salt")
    runs = staged(
        dealt.repartitionByRange("lead", "h", "salt").select(
            "doc_id", "is_hot", "salt", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), best("doc_id").over(run).alias("run_keep"), F.count("*").over(run).alias("run_size"),
        ),
        "runs",
    )
    # A row for each run of a hot text: at most HOT * SALTS.
    ends = runs.filter("is_hot").groupBy("text_sha256", "salt").agg(best("run_keep").alias("run_keep"), F.max("run_size").alias("run_size"))
    whole = ends.groupBy("text_sha256").agg(best("run_keep").alias("hot_keep"), F.sum("run_size").alias("hot_size"))
    out = runs.join(F.broadcast(whole), "text_sha256", "left")
    keep = F.when(F.col("is_hot"), F.col("hot_keep")).otherwise(F.col("run_keep"))
    size = F.when(F.col("is_hot"), F.col("hot_size")).otherwise(F.col("run_size"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
