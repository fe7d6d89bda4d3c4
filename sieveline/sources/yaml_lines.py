"""Top-level keys of YAML descriptors, read line by line as a relation.

A line that begins with a letter opens a section; the indented lines and dashes below belong to it, whatever they nest. A section
is a text, a list in brackets, a list of dashes, or a block of lines; of sections with the same key the last counts. Anything else of
YAML is ignored. Lines are numbered within their descriptor, whose size is bounded, so a window a descriptor adds up the sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import safe_text

BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLOCKS = ["|", ">", "|-", ">-", "|+", ">+"]
SPACE = r"(?U)^\s+|\s+\z"
#: Items of a list that are read.
ITEMS = 100


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def unquoted(value: Column) -> Column:
    """A value without the quotes around it, if they are a pair."""
    first = F.substring(value, 1, 1)
    pair = (F.length(value) >= 2) & first.isin("'", '"') & (F.substring(value, -1, 1) == first)
    return F.when(pair, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def sections(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, value, items for rows of keys and text: a row for each top-level key, value of texts and blocks, items of lists; the other is null."""
    lines = texts.select(*keys, F.posexplode(F.split("text", BREAKS)).alias("at", "line"))
    lines = lines.withColumn("bare", _bare(F.col("line"))).filter((F.col("bare") != "") & ~F.col("bare").startswith("#"))
    opens = ~F.substring("line", 1, 1).isin(" ", "\t", "-")
    of = Window.partitionBy(*keys).orderBy("at")
    numbered = lines.withColumns({"opens": opens, "section": F.sum(opens.cast("int")).over(of)})
    gathered = numbered.groupBy(*keys, "section").agg(
        F.max(F.when(F.col("opens"), F.col("line"))).alias("head"), F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("at", "bare")))).alias("below"),
    )
    colon = F.instr("head", ":")
    rest = F.expr("substring(head, instr(head, ':') + 1)")
    said = gathered.filter(colon > 0).select(*keys, "section", _bare(F.expr("substring(head, 1, instr(head, ':') - 1)")).alias("key"), _bare(F.substring_index(rest, " #", 1)).alias("said"), F.transform("below", lambda x: x["bare"]).alias("below"))
    dashes = F.transform(F.filter("below", lambda x: x.startswith("-")), lambda x: unquoted(_bare(F.substring(x, F.lit(2), F.length(x)))))
    listed = F.transform(F.filter(F.split(F.expr("substring(said, 2, length(said) - 2)"), ","), lambda x: _bare(x) != ""), lambda x: unquoted(_bare(x)))
    in_brackets = F.col("said").startswith("[") & F.col("said").endswith("]") & (F.length("said") >= 2)
    items = F.when(F.col("said") == "", dashes).when(in_brackets, listed)
    value = F.when((F.col("said") == "") | in_brackets, None).when(F.col("said").isin(BLOCKS), F.array_join("below", "\n")).otherwise(unquoted(F.col("said")))
    rows = said.select(*keys, "section", "key", value.alias("value"), items.alias("items"))
    return rows.groupBy(*keys, "key").agg(F.max_by(F.struct("value", "items"), "section").alias("r")).select(*keys, "key", "r.*")


def plugins(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the fields of a plug-in's descriptor: name, main, version, api_version, description, website, authors, needs, wants. Those that have neither a name nor a main class as text are left out."""
    of = sections(texts, keys)
    names = {"name": "name", "main": "main", "version": "version", "api-version": "api_version", "website": "website"}
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    items = lambda key: F.max(F.when(F.col("key") == key, F.coalesce("items", F.array("value"))))
    rows = of.groupBy(*keys).agg(
        *[value(key).alias(name) for key, name in names.items()], value("description").alias("description"),
        *[items(key).alias(name) for key, name in (("authors", "authors"), ("author", "author"), ("depend", "needs"), ("softdepend", "wants"))],
    )
    none = F.array().cast("array<string>")
    some = lambda c, most: F.transform(F.slice(F.coalesce(c, none), 1, ITEMS), lambda x: safe_text(x, most))
    return rows.filter("name is not null or main is not null").select(
        *keys, *[F.when(F.col(n).isNotNull(), safe_text(F.col(n), 300 if n in ("main", "website") else 500)).alias(n) for n in names.values()],
        F.when(F.col("description").isNotNull(), safe_text(_bare(F.col("description")), 2000, newlines=True)).alias("description"),
        F.concat(some(F.col("authors"), 200), some(F.col("author"), 200)).alias("authors"), some(F.col("needs"), 300).alias("needs"), some(F.col("wants"), 300).alias("wants"),
    )
