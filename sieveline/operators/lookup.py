"""Joins with small dimensions: lookups with a default, exact before prefix, wildcards, anti joins, look-alikes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import normalized_name, skeleton


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def with_default(rows: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with dim's value for their key, default where there is none. Spark broadcasts dim if its size allows."""
    return rows.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def exact_else_prefix(name: Column, exact: dict[str, str], prefixes: dict[str, str]) -> Column:
    """exact's value for a name; where there is none that of the first prefix that fits, or null."""
    by_prefix = F.lit(None).cast("string")
    for prefix, value in reversed(prefixes.items()):
        by_prefix = F.when(name.startswith(prefix), value).otherwise(by_prefix)
    return F.coalesce(_map(exact)[name], by_prefix)


def exact_else_wildcard(owner: Column, member: Column, table: dict[str, str]) -> Column:
    """The value of owner#member, else that of *#member, else null."""
    of = _map(table)
    return F.coalesce(of[F.concat(owner, F.lit("#"), member)], of[F.concat(F.lit("*#"), member)])


def missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among present's."""
    return rows.join(present.select(key).distinct(), key, "left_anti")


def lookalike(name: Column, known: list[str], least: int = 3, shortest: int = 5) -> Column:
    """struct(known, kind, distance) of the known name that a name imitates, or null.

    Names with fewer than `least` signs, known names shorter than `shortest`, and names that begin with the known one
    are left alone. Skeletons are compared: an equal one counts before the least edit distance (at most 1, and 2 for
    known names from 8 signs on), ties go by name.
    """
    n = normalized_name(name)
    sk = skeleton(n)
    names = F.array(*[F.struct(F.lit(k).alias("known")) for k in sorted(known) if len(k) >= shortest])
    rated = F.transform(names, lambda k: F.struct(
        F.when(skeleton(k["known"]) == sk, 0).otherwise(1).alias("rank"), F.levenshtein(sk, skeleton(k["known"])).alias("distance"), k["known"].alias("known"),
    ))
    near = F.filter(rated, lambda r: ~n.startswith(r["known"]) & (r["distance"] <= F.when(F.length(r["known"]) < 8, 1).otherwise(2)))
    best = F.array_min(near)
    found = F.struct(best["known"].alias("known"), F.when(best["rank"] == 0, "skeleton").otherwise("distance").alias("kind"), best["distance"].alias("distance"))
    return F.when((F.length(n) >= least) & ~n.isin(known) & best.isNotNull(), found)
