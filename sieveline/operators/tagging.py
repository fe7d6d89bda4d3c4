"""Tags of keys and which keys combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags_by_key(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys with the sorted distinct tags of their rows."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def has_all_of_any(tags: Column, *sets: list[str]) -> Column:
    """At least one tag out of each set."""
    out = F.lit(True)
    for wanted in sets:
        out = out & has_any(tags, wanted)
    return out


def spread(tagged: DataFrame, group: list[str], first: list[str], second: list[str]) -> DataFrame:
    """Groups that have tags of both sets, but no single key that has both: group, n_first, n_second."""
    a, b = has_any(F.col("tags"), first), has_any(F.col("tags"), second)
    sums = tagged.groupBy(*group).agg(F.count_if(a).alias("n_first"), F.count_if(b).alias("n_second"), F.count_if(a & b).alias("n_both"))
    return sums.filter("n_first > 0 and n_second > 0 and n_both = 0").drop("n_both")
