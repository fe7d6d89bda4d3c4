r"""Operator 11 [native]: line dedup by levelled sorted runs of line hashes.

A text is split at \n. A line's key is the line without `[\x20\x09-\x0D]` at both ends, A-Z lower-cased; keys of at
least LEAST_CHARS code points that LEAST_DOCUMENTS documents hold lose all their lines but those of the largest doc_id.

Documents come in batches, those with the largest ids first. A batch is reduced to a row a key (two 64-bit hashes, number of documents, largest id)
and merge-anti-joined with the runs so far: a key that a run has settled, with enough documents and an id as large, adds nothing
and goes. What is left is a run of level 0. FANOUT runs of a level are compacted to one of the next, so each key is
rewritten once a level. Runs are tables bucketed and sorted by hash: joining and compacting them moves none of their rows.

A key in a third of all documents is a row for each task before anything is shuffled, and a row for each run afterwards; in the last join the documents' hashes meet
the repeated keys in a plain join of two shuffled sides, which adaptive execution splits where a key is hot. Hashes are 128 bits: among 10**12 lines two
different keys meet with a probability of about 10**-15.
"""

from __future__ import annotations

import atexit
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import removed, scratch, staged

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: Batches that one table is read in, and runs of a level that are compacted to one of the next.
BATCHES, FANOUT = 4, 2
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _identity(text: Column) -> list[Column]:
    """128 bits of a row's id and text: rows that are equal in both lose the same lines, so they need no number of their own."""
    return [F.xxhash64("doc_id", text).alias("t1"), F.xxhash64(F.lit(1), "doc_id", text).alias("t2")]


def hashed(documents: DataFrame) -> DataFrame:
    """doc_id, t1, t2, keys of the documents that have long lines: keys is (h1, h2, at, first) in order, first being whether the row has the key at an earlier place in that order."""
    text = F.coalesce("text", F.lit(""))
    lines = documents.select("doc_id", *_identity(text), _lines(text).alias("lines"))
    keyed = lines.select("doc_id", "t1", "t2", F.transform("lines", lambda x, k: F.struct(line_key(x).alias("key"), k.alias("at"))).alias("keyed"))
    long = F.filter("keyed", lambda x: F.length(x["key"]) >= LEAST_CHARS)
    hashes = F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["at"].alias("at")))
    sorted_ = keyed.select("doc_id", "t1", "t2", F.sort_array(hashes).alias("s")).filter(F.size("s") > 0)

    def told(x: Column, k: Column) -> Column:
        before = F.get("s", k - 1)
        same = (k > 0) & (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
        return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), (~F.coalesce(same, F.lit(False))).alias("first"))

    return sorted_.select("doc_id", "t1", "t2", F.transform("s", told).alias("keys"))


def counted(hashes: DataFrame) -> DataFrame:
    """h1, h2, n, keep of a batch: a row a key, with the number of documents that hold it and their largest id."""
    each = hashes.select("doc_id", F.explode("keys").alias("k")).filter("k.first")
    return each.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))


class Runs:
    """Levelled runs of (h1, h2, n, keep): n and keep of a key are the sum and the maximum over the runs that have it.

    Batches may come in any order; keys settled by a run are left out of later ones, which leaves n >= LEAST_DOCUMENTS and keep as they would be. Every run is
    a table in the shared folder; compacted ones are deleted at once, the others with release() or when the driver ends.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Adds what a batch (counted) brings that the runs have not settled."""
        for run in self.all():
            settled = (run["n"] >= LEAST_DOCUMENTS) & (batch["keep"].isNull() | (run["keep"] >= batch["keep"]))
            batch = batch.join(run.hint("merge"), (batch["h1"] == run["h1"]) & (batch["h2"] == run["h2"]) & settled, "left_anti")
        self._put(0, self._written(batch))

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """A row a key over all runs: a merge join of two, and of its result with any further one."""
        return reduce(_both, self.all() if runs is None else runs)

    def release(self) -> None:
        for run in self.all():
            self._dropped(run)
        self.levels = []

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._written(self.merged(old)))
            for x in old:
                self._dropped(x)

    def _written(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{scratch(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(name)
        atexit.register(removed, self.spark, path)
        run = self.spark.table(name)
        run.run_of = (name, path)
        return run

    def _dropped(self, run: DataFrame) -> None:
        name, path = run.run_of
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, path)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one. (A union of bucketed scans under an aggregation would look co-partitioned, but Spark 4.1 concatenates its columnar partitions.)"""
    rows = a.select("h1", "h2", F.col("n").alias("n1"), F.col("keep").alias("k1")).join(b.select("h1", "h2", F.col("n").alias("n2"), F.col("keep").alias("k2")).hint("merge"), ["h1", "h2"], "full_outer")
    n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    return rows.select("h1", "h2", n.alias("n"), F.greatest("k1", "k2").alias("keep"))


def _batches(hashes: DataFrame, batches: int) -> list[DataFrame]:
    """hashes in parts by doc_id, the largest first; null comes last."""
    cuts = hashes.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = sorted(set(cuts or []))
    doc, parts = F.col("doc_id"), []
    for low, high in zip([None, *edges], [*edges, None]):
        part = F.lit(True) if low is None else doc > low
        parts.append(part if high is None else part & (doc <= high))
    if edges:
        parts[0] = doc.isNull() | parts[0]
    return [hashes.filter(p) for p in reversed(parts)]


def dropped(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """t1, t2, places: the places (from 0) of the lines that go, of the documents that lose any."""
    hashes = staged(hashed(documents), "line-hashes")
    runs = Runs(documents.sparkSession, fanout)
    for batch in _batches(hashes, batches):
        runs.add(counted(batch))
    repeated = staged(runs.merged().filter(F.col("n") >= LEAST_DOCUMENTS).select("h1", "h2", "keep"), "repeated-lines")
    runs.release()
    each = hashes.select("doc_id", "t1", "t2", F.explode("keys").alias("k")).select("doc_id", "t1", "t2", "k.h1", "k.h2", "k.at")
    gone = each.join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return gone.groupBy("t1", "t2").agg(F.collect_set("at").alias("places"))


def _rebuilt(documents: DataFrame, batches: int, fanout: int) -> DataFrame:
    """row (the document's own columns), doc_id, kept, n_lines, n_dropped."""
    text = F.coalesce("text", F.lit(""))
    gone = dropped(documents, batches, fanout).withColumnsRenamed({"t1": "g1", "t2": "g2"})
    rows = documents.select(F.struct("*").alias("row"), "doc_id", text.alias("whole"), *_identity(text))
    met = rows.join(gone, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left").withColumn("lines", _lines(F.col("whole")))
    n = F.size("lines")
    # array_except hashes numbers and keeps the order: linear in the lines of a text, however many go.
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    return met.select("row", "doc_id", kept.alias("kept"), n.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def deduplicated(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """documents with their own columns, whatever their names, and in text the lines that stay."""
    out = _rebuilt(documents, batches, fanout)
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns])


def line_digests(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 (of the lines that stay, joined by newlines), one row per row of documents.

    Null and empty texts are one empty line. A document is a row: rows that repeat a doc_id count each for itself, and as the largest
    id they all keep a line. A null doc_id loses to any other; a key that only such rows hold stays in all of them. A line that a text repeats
    counts once for the text and goes or stays as a whole. Texts of any length and number of lines are read whole, in time that follows
    their lines. An empty table gives an empty result; extra columns are ignored (deduplicated carries them).
    """
    out = _rebuilt(documents.select("doc_id", "text"), batches, fanout)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
told AS (SELECT l.*, p.key IS NOT NULL AND doc_id IS DISTINCT FROM keep AS gone FROM keyed l LEFT JOIN repeated p ON l.key = p.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY r, doc_id
"""
