"""Order-dependent reductions: caps with a remainder row, first-k lists, first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, group: list[str], order: list, most: int, number: str = "rn") -> DataFrame:
    """The first `most` rows of each group with their number. A group is cut to them in every task before it is shuffled (up to 1000 rows, as Spark is set), so its size does not matter."""
    of = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(number, F.row_number().over(of)).filter(F.col(number) <= most)


def capped(rows: DataFrame, group: list[str], order: list, most: int, severity: str = "severity_rank", confidence: str = "confidence_rank") -> DataFrame:
    """The first `most` rows of each group, and for a larger group one row more that stands for the rest.

    That row has is_rest, n_rest, the worst severity of the whole group and the highest confidence among the rest. The group is only counted by
    confidence, less the rows that are kept; it is never together in one task. rows is read twice.
    """
    kept = first_rows(rows, group, order, most).withColumn("rn", F.col("rn").cast("long")).withColumns({"is_rest": F.lit(False), "n_rest": F.lit(0).cast("long")})
    counts = rows.groupBy(*group, F.col(confidence).alias("_confidence")).agg(F.count("*").alias("_n"), F.max(severity).alias("_worst"))
    less = kept.select(*group, F.col(confidence).alias("_confidence"), F.lit(-1).cast("long").alias("_n"), F.lit(None).cast(rows.schema[severity].dataType).alias("_worst"))
    left = counts.unionByName(less).groupBy(*group, "_confidence").agg(F.sum("_n").alias("_n"), F.max("_worst").alias("_worst"))
    rest = left.groupBy(*group).agg(F.sum("_n").alias("n_rest"), F.max("_worst").alias(severity), F.max(F.when(F.col("_n") > 0, F.col("_confidence"))).alias(confidence)).filter("n_rest > 0")
    rest = rest.withColumns({"rn": F.lit(most + 1).cast("long"), "is_rest": F.lit(True)})
    return kept.unionByName(rest, allowMissingColumns=True)


def where_list(items: Column, total: Column, shown: int = 5) -> Column:
    """The first items joined by commas and how many more there are; (archive) where there is none."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    more = F.when(total > shown, F.concat(F.lit(" (+"), (total - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(total > 0, F.concat(head, more)).otherwise("(archive)")


def where_of(rows: DataFrame, group: list[str], order: list[str], item: str, shown: int = 5, sums: dict[str, Column] | None = None) -> DataFrame:
    """group with n and `where`: where_list over the group's items in order, and `sums`, further aggregates of the whole group.

    Only the first `shown` items of a group are gathered, all are counted; rows is read twice.
    """
    sums = sums or {}
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()])
    first = first_rows(rows, group, order, shown, "_rn").select(*group, F.struct("_rn", F.col(item).alias("item")).alias("_item"))
    both = counts.unionByName(first, allowMissingColumns=True).groupBy(*group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("_item")).alias("_items"), *[F.max(name).alias(name) for name in sums])
    return both.select(*group, "n", where_list(F.col("_items.item"), F.col("n"), shown).alias("where"), *sums)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in order. Aggregated, so copies of a key are dropped before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
