"""Joins with dimension tables of any size where equality is not the condition: look-alike names and prefixes.

Each condition is turned into keys that both sides have, so that rows and table meet in an equi join; only what meets there is
compared. What is broadcast is counted first, and shuffled beyond BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import normalized_name, skeleton

#: Rows of an index that are broadcast at most (some 30 MB).
BROADCAST_ROWS = 500_000
#: Longest skeleton that is indexed whole; of longer ones the first and last END characters are.
WHOLE, END = 24, 10


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df to be broadcast if its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _cores(text: Column, whole_to: int, ends_from: int) -> Column:
    """What stands for a skeleton in the index: itself up to a length, from another on its two ends."""
    ends = F.concat(F.substring(text, 1, END), F.lit(" "), F.substring(text, -END, END))
    return F.array_compact(F.array(F.when(F.length(text) <= whole_to, text), F.when(F.length(text) >= ends_from, ends)))


def with_keys(rows: DataFrame, text: Column, edits: Column, whole_to: int = WHOLE, ends_from: int = WHOLE + 1) -> DataFrame:
    """rows with `key`, once for each 64-bit key: text with up to `edits` (0 to 2) characters left out.

    Strings within that many edits of each other have such a rest in common. A string longer than WHOLE is represented by its ends, which do not overlap and share the
    edits between them, so there are at most 301 keys, whatever its length. Places are exploded, not folded over, so that the pieces are cut in generated code.
    """
    cores = rows.withColumns({"_edits": edits, "_core": F.explode(_cores(text, whole_to, ends_from))})
    n, a, b, core = F.length("_core"), F.col("_a"), F.col("_b"), F.col("_core")
    # Left out are the characters at a and b, a < b; 0 stands for none.
    first = cores.withColumn("_a", F.explode(F.sequence(F.lit(0), F.when(F.col("_edits") >= 2, F.greatest(n - 1, F.lit(0))).otherwise(0))))
    both = first.withColumn("_b", F.explode(F.sequence(F.when(a == 0, 0).otherwise(a + 1), F.when(F.col("_edits") >= 1, n).otherwise(0))))
    behind = F.substring(core, b + 1, n)
    one = F.concat(F.substring(core, F.lit(1), b - 1), behind)
    two = F.concat(F.substring(core, F.lit(1), a - 1), F.substring(core, a + 1, b - a - 1), behind)
    return both.withColumn("key", F.xxhash64(F.when(b == 0, core).when(a == 0, one).otherwise(two))).drop("_edits", "_core", "_a", "_b")


def known_names(known: DataFrame, column: str, shortest: int = 5) -> DataFrame:
    """known, sk, edits: normalised names of a table, with their skeletons and how far another name may be. Those shorter than `shortest` are none that others imitate."""
    names = known.select(normalized_name(F.col(column)).alias("known")).filter(F.length("known") >= shortest).distinct()
    return names.select("known", skeleton(F.col("known")).alias("sk"), F.when(F.length("known") < 8, 1).otherwise(2).alias("edits"))


def name_index(rated: DataFrame) -> DataFrame:
    """key, known, sk, edits: the index of known_names.

    Near the length at which ends stand for the whole, names are in the index both ways: either side of a pair may be the longer one.
    """
    return with_keys(rated, F.col("sk"), F.col("edits"), WHOLE + 2, WHOLE - 2).select("key", "known", "sk", "edits").distinct()


def candidates(names: DataFrame, rated: DataFrame) -> DataFrame:
    """n, sk, known, known_sk, edits for names (n) and known_names: what is measured, a row for each key that a name and a known one share.

    Names of a length that no known name is near have no keys, and only those near one that allows two edits have keys of two.
    """
    size = F.length("sk")
    least, most, two = rated.agg(F.min(size), F.max(size), F.min(F.when(F.col("edits") == 2, size))).first()
    near = F.lit(False) if least is None else size.between(least - 2, most + 2)
    edits = F.lit(1) if two is None else F.when(size >= two - 2, 2).otherwise(1)
    keyed = with_keys(names.select("n", skeleton(F.col("n")).alias("sk")).filter(near), F.col("sk"), edits)
    close = F.abs(size - F.length("known_sk")) <= F.col("edits")
    return keyed.join(sized(name_index(rated).withColumnRenamed("sk", "known_sk")), "key").filter(close).drop("key")


def normalized(names: DataFrame) -> DataFrame:
    """_name, _n for distinct names (_name): _n is the normalised one.

    Conditions on a projection are moved below distinct(), so that the pattern is evaluated several times for each row that it drops; on something exploded, here
    an array of one, they are not.
    """
    return names.select("_name", F.explode(F.array(normalized_name(F.col("_name")))).alias("_n"))


def lookalikes(rows: DataFrame, name: str, known: DataFrame, column: str, least: int = 3, shortest: int = 5) -> DataFrame:
    """rows with `like`: struct(known, kind, distance) of the known name that a row's name imitates, or null.

    As operators.lookup.lookalike: names of fewer than `least` signs, known names shorter than `shortest`, names that are known themselves and names that begin with the
    known one are left alone; an equal skeleton counts before the least edit distance (at most 1, and 2 for known names from 8
    signs on), ties go by name. Each distinct name is normalised and measured once, against the names that share a key of the index only. Null names have none.
    """
    if "like" in rows.columns:
        rows = rows.drop("like")
    own = normalized(rows.select(F.col(name)).distinct().toDF("_name").filter("_name is not null"))
    names = own.select(F.col("_n").alias("n")).filter(F.length("n") >= least)
    # A name has up to 301 keys, so that its bytes tell little of its work: the partitions are not coalesced by size.
    names = names.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n").distinct()
    present = known.select(normalized_name(F.col(column)).alias("n")).distinct()
    names = names.join(sized(present), "n", "left_anti")
    distance = F.levenshtein("sk", "known_sk", 2)
    met = candidates(names, known_names(known, column, shortest)).filter(~F.col("n").startswith(F.col("known"))).withColumn("distance", distance)
    near = met.filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
    rank = F.when(F.col("sk") == F.col("known_sk"), 0).otherwise(1)
    best = near.groupBy("n").agg(F.min(F.struct(rank.alias("rank"), "distance", "known")).alias("best"))
    like = F.struct(F.col("best.known").alias("known"), F.when(F.col("best.rank") == 0, "skeleton").otherwise("distance").alias("kind"), F.col("best.distance").alias("distance"))
    found = own.join(best.select(F.col("n").alias("_n"), like.alias("like")), "_n").select("_name", "like")
    return rows.join(found, rows[name] == found["_name"], "left").select(*[rows[c] for c in rows.columns], found["like"])


def with_prefix_of(rows: DataFrame, name: str, exact: DataFrame, prefixes: DataFrame, order: str) -> DataFrame:
    """rows with `value`: exact's (name, value) for a row's name, else that of the first of prefixes (prefix, value, and `order`) that the name begins with, else null.

    Prefixes are in buckets by first character and length. A distinct name is cut to the lengths that its first character has, and the pieces meet
    the table in an equi join. Prefixes that tie on `order` go by themselves; a prefix of no characters fits every name, a null one none; exact names that repeat give their least value.
    """
    if "value" in rows.columns:
        rows = rows.drop("value")
    head = lambda c: F.substring(c, 1, 1)
    table = prefixes.filter("prefix is not null").select("prefix", F.col("value").alias("by_prefix"), F.col(order).alias("place"))
    lengths = table.groupBy(head(F.col("prefix")).alias("head")).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    names = rows.select(F.col(name).alias("_name")).filter("_name is not null").distinct()
    whole = exact.groupBy(F.col("name").alias("_name")).agg(F.min("value").alias("by_name"))
    met = names.join(sized(whole), "_name", "left")
    cut = met.filter("by_name is null").select("_name", F.explode(F.array_distinct(F.array(head(F.col("_name")), F.lit("")))).alias("head")).join(sized(lengths), "head")
    pieces = cut.select("_name", F.explode(F.filter("lengths", lambda n: n <= F.length("_name"))).alias("n")).select("_name", F.expr("substring(_name, 1, n)").alias("prefix"))
    first = pieces.join(sized(table), "prefix").groupBy("_name").agg(F.min(F.struct("place", "prefix", "by_prefix")).alias("first"))
    of = met.filter("by_name is not null").select("_name", F.col("by_name").alias("value")).unionByName(first.select("_name", F.col("first.by_prefix").alias("value")))
    return rows.join(of, F.col(name) == F.col("_name"), "left").select(*[rows[c] for c in rows.columns], "value")
