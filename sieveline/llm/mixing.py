"""Operator 7 [native]: mixing sources to target weights.

Tokens are aggregated per source, repetition rates follow from the targets, and each document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with the rate's fraction as its probability.

Targets: sources in order of code points (null last) weigh 1, 2, 3, repeating, and share all sizes; none
takes more than CAP times its own size, and what is over is shared again by weight. That is min(CAP *
size, level * weight) with one level for all, found by a running sum over sources in order of
CAP * size / weight.

One seed would leave a source whose few long documents fall on one side far off its target. So each
document has SEEDS draws from one hash, every source's total is known for each seed from the same
aggregation, and the source uses the seed that comes nearest. A draw under one seed has the stated probability; the
choice of the seed by its total makes the draws of a source depend on each other.

Texts are read once for their sizes, which are staged by id; everything else works on these short rows, and
documents meet only the table of sources, which is broadcast while its counted rows are few and
salted beyond that, as one source may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import staged

CAP = 3
SEEDS = 32
#: Sources that may be broadcast (some 10 MB); parts that a source's rows are dealt to beyond that.
BROADCAST_SOURCES, SALTS = 100_000, 64
_SPAN = 2**32


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size of documents, staged: size is the number of words [^\\x20\\x09-\\x0D]+ of the whole text (null: 0)."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return staged(documents.select("doc_id", "source", size.alias("size")), "sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for rows of (source, source_size), one a source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(ordered) - 1) % 3 + 1)
    capped = weighed.withColumn("most", F.lit(CAP) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source that the level does not fill sets it.
    open_ = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    final = open_.withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("x"), F.col("level").alias("level")))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")), F.col("most").cast("double"))
    return final.select("source", "source_size", target.alias("target"))


def _key(documents: DataFrame):
    """Two 32-bit halves of one hash of the id; draw k is (a + k * b) modulo 2**32."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1).alias("a"), half(9).alias("b")


def _copies(rate, seed):
    extra = ((F.col("a") + seed * F.col("b")) % _SPAN) < (rate - F.floor(rate)) * _SPAN
    return (F.floor(rate) + extra.cast("long")).cast("long")


def plan(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, rate, seed for rows of (doc_id, source, size): a row per source."""
    own = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rated = staged(own.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    draws = [(F.col("size") * _copies(F.col("rate"), k)).alias(f"t{k}") for k in range(SEEDS)]
    drawn = _with_source(sizes.select("source", "size", "doc_id", *_key(sizes)), rated.select("source", "target", "rate")).select("source", "target", *draws)
    sums = drawn.groupBy("source", "target").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(SEEDS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    return staged(_with_source(rated.withColumn("doc_id", F.lit(0)), sums.select("source", nearest["seed"].alias("seed"))).drop("doc_id"))


def _with_source(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (with doc_id) with the columns of their source in of (a row for each source); a null source matches itself."""
    of = of.withColumnRenamed("source", "of_source")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if of.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(of), same).drop("of_source")
    dealt = rows.withColumn("of_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(of, same & (F.col("of_salt") == F.col("salt"))).drop("of_source", "of_salt", "salt")


def repeated(documents: DataFrame) -> DataFrame:
    """The mix itself: documents' own columns (whatever their names), each row as often as it is taken."""
    of = plan(sized(documents)).select("source", "rate", "seed")
    rows = documents.select(F.struct("*").alias("row"), "doc_id", "source")
    drawn = _with_source(rows.select("*", *_key(rows)), of).select("row", _copies(F.col("rate"), F.col("seed")).cast("int").alias("copies")).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*").select(*documents.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS most,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM sources WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(most AS DOUBLE), (SELECT arg_min(level, CAST(most AS DOUBLE) / weight) FROM levels WHERE level * weight < most) * weight), CAST(most AS DOUBLE)) AS target
  FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
keyed AS (
  SELECT s.*, r.source_size, r.target, r.rate,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8) AS BIGINT) AS a,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 9, 8) AS BIGINT) AS b
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT k.*, seed, CAST(floor(rate) AS BIGINT) + CASE WHEN (a + seed * b) % 4294967296 < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END AS copies
  FROM keyed k, range(32) t(seed)),
seeds AS (
  SELECT source, arg_min(seed, {'off': off, 'seed': seed}) AS seed
  FROM (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS off FROM drawn GROUP BY source, seed) GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.seed = s.seed
"""


def taken(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row, repeats counted.

    Null text has size 0; null source is a source of its own; sources without words have target 0. Rows
    that repeat a doc_id draw alike, each for itself; texts of any length count whole. An empty table gives an empty
    result; extra columns are ignored.
    """
    sizes = sized(documents)
    rows = _with_source(sizes.select("*", *_key(sizes)), plan(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("rate"), F.col("seed"))).alias("taken"))
