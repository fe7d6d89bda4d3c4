"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node links its larger (large) or its smaller (small) neighbours to its least neighbour."""
    around = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = around.join(least, "u")
    if large:
        new = near.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        new = near.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return new.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a < b), root being the least node that it reaches. The number of rounds follows the logarithm of the longest path."""
    now, before = staged(edges.select("a", "b").distinct()), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before, last = mark, now
        now = staged(_star(_star(now, True), False), "components")
        discard(last)
    # Each node now has one edge, to its root.
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(now.select("a", F.col("a")).distinct())
