"""Aggregates over findings and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.capping import first_rows
from sieveline.refdata import CONFIDENCES, SEVERITIES


def rank_of(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def severity_rank(column: Column) -> Column:
    return rank_of(column, SEVERITIES)


def confidence_rank(column: Column) -> Column:
    return rank_of(column, CONFIDENCES)


def name_of(rank: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for name, r in ranks.items():
        out = F.when(rank == r, name).otherwise(out)
    return out


def severity_rollup(findings: DataFrame, group: list[str]) -> DataFrame:
    """group with counts by severity, the highest one and a sentence."""
    counts = findings.groupBy(*group).agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES], F.max(severity_rank(F.col("severity"))).alias("worst"),
    )
    w, r = F.col("n_warning"), F.col("n_review")
    said = (
        F.when(w > 0, F.concat(w.cast("string"), F.lit(" warnings and "), r.cast("string"), F.lit(" items to review")))
        .when(r > 0, F.concat(r.cast("string"), F.lit(" items to review")))
        .otherwise("nothing to review")
    )
    return counts.select(*group, "n_info", "n_review", "n_warning", name_of(F.col("worst"), SEVERITIES).alias("highest"), said.alias("summary"))


def placed(rows: DataFrame, group: list[str], seq: str, place: str, lead: list[str] = [], width: int = 1 << 20) -> DataFrame:
    """rows with their number within group (any size, empty too): greatest lead first, then least seq, which is a whole number.

    Rows are numbered within ranges of `width` of seq, so that no group lands in one task. Only the ranges' counts are added up in
    one window a group. Ranges depend on values alone: a task that runs again numbers as before.
    """
    of = [*group, *lead]
    ranged = rows.withColumn("_range", F.floor(F.col(seq) / F.lit(width)))
    sizes = ranged.groupBy(*of, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in lead], "_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(*[F.col(c).alias(f"_of{k}") for k, c in enumerate([*of, "_range"])], "_before")
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*of, "_range").orderBy(seq)))
    same = F.lit(True)
    for k, c in enumerate([*of, "_range"]):
        same = same & own[c].eqNullSafe(sizes[f"_of{k}"])
    return own.join(sizes, same).select(*[own[c] for c in rows.columns], (F.col("_before") + F.col("_own")).cast("long").alias(place))


def most_common(rows: DataFrame, group: list[str], value: str, seq: str) -> DataFrame:
    """Counts of values within group, with their place: most frequent first, ties as first seen."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    return placed(counts, group, "first_seq", "place", ["n"])


def repeated_names(rows: DataFrame, group: list[str], name: str, seq: str) -> DataFrame:
    """Second and later rows of a name, in order of seq."""
    return placed(rows, [*group, name], seq, "copy").filter("copy > 1")


def inconsistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-empty value: key, n_values, values."""
    full = rows.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    return full.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("greatest")).filter("n_values > 1")


def shared_ids(rows: DataFrame, owner: str, ident: str, shown: int = 5) -> DataFrame:
    """Ids (in lower case) that several owners have: owner, id, n_owners, others.

    others lists the first owners by name other than the row's own. An id's owners are counted by aggregation and cut to the first shown + 1 before
    they are shuffled; only the last join brings an id's rows together, which Spark splits where there are many.
    """
    distinct = rows.select(F.col(owner).alias("owner"), F.lower(ident).alias("id")).filter("id <> ''").distinct()
    counts = distinct.groupBy("id").agg(F.count("*").alias("n_owners"))
    first = first_rows(distinct, ["id"], ["owner"], shown + 1, "_rn").select("id", F.col("owner").alias("_name"))
    several = counts.unionByName(first, allowMissingColumns=True).groupBy("id").agg(F.max("n_owners").alias("n_owners"), F.sort_array(F.collect_list("_name")).alias("names")).filter("n_owners > 1")
    others = F.slice(F.filter("names", lambda x: x != F.col("owner")), 1, shown)
    return distinct.join(several, "id").select("owner", "id", "n_owners", F.array_join(F.transform(others, lambda x: x.cast("string")), ", ").alias("others"))


def short_name_ratio(rows: DataFrame, group: list[str], name: str, short: int = 2) -> DataFrame:
    """group with n, n_short, ratio and a verdict: obfuscated from half of at least ten names on, partly from a fifth and ten short names."""
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.length(name) <= short).alias("n_short"))
    ratio = F.col("n_short") / F.col("n")
    verdict = F.when((F.col("n") >= 10) & (ratio >= 0.5), "obfuscated").when((ratio >= 0.2) & (F.col("n_short") >= 10), "partly").otherwise("plain")
    return sums.withColumns({"ratio": F.round(ratio, 6), "verdict": verdict})


def rolled_up(findings: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """Findings of nested nodes shown at their root: INFO stays where it is, others are located `inner → place`."""
    root = F.substring_index(path, separator, 1)
    inner = F.substring(F.col(path), F.length(root) + F.length(F.lit(separator)) + 1, F.length(path))
    nested = F.contains(F.col(path), F.lit(separator))
    kept = findings.filter(~nested | (F.col("severity") != "INFO"))
    place = F.when(nested, F.concat(F.replace(inner, F.lit(separator), F.lit(" → ")), F.lit(" → "), F.col("location"))).otherwise(F.col("location"))
    return kept.withColumns({"root": root, "location": place})
