"""Manifests and project descriptors of archives, parsed by expressions over their text."""

from __future__ import annotations

import json
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.sources.yaml_lines import ITEMS, plugins

NODE = ["archive_id", "node_path"]


def _text(content: Column) -> Column:
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "\r\n?", "\n")


def manifest(read: DataFrame, most: int = 500) -> DataFrame:
    """node, key, value, position of the main section's attributes: continuation lines joined, a later value of a key wins."""
    main = F.regexp_extract(_text(F.col("content")), r"^((?:.+\n?)*)", 1)
    lines = F.split(F.regexp_replace(main, r"[ \t]*\n ", ""), "\n")
    found = read.filter("kind = 'entry' and lower(name) = 'meta-inf/manifest.mf' and content is not null")
    # The exact name counts before other spellings.
    one = found.groupBy(*NODE).agg(F.min_by("content", F.struct(F.col("name") != "META-INF/MANIFEST.MF", "entry_seq")).alias("content"))
    rows = one.select(*NODE, F.posexplode(F.slice(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), 1, most)).alias("position", "line"))
    rows = rows.select(*NODE, "position", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))
    return rows.groupBy(*NODE, "key").agg(F.max_by("value", "position").alias("value"), F.min("position").alias("position"))


def _toml_as_json(text: pa.Array) -> pa.Array:
    """TOML documents as JSON; null where they are none."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(tomllib.loads(t), default=str)
        except (tomllib.TOMLDecodeError, RecursionError, ValueError):
            return None

    return pa.array([one(t) for t in text.to_pylist()], pa.string())


def _get(v: Column, path: str) -> Column:
    """A text or number at a path; null for other types and where there is none."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    """Texts of a list at a path: its strings, or a field of its objects."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(F.slice(items, 1, ITEMS), lambda x: F.coalesce(_get(x, "$"), _get(x, "$.value"), _get(x, "$.name"), _get(x, "$.id")))
    return F.filter(named, lambda x: x.isNotNull())


def _entry_points(v: Column) -> Column:
    lists = F.map_values(F.coalesce(F.try_variant_get(v, "$.entrypoints", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.flatten(F.transform(lists, lambda x: _list(x, "$")))


def _texts(v: Column) -> Column:
    """A text as a list of one, or the texts and numbers of a list."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.filter(F.transform(items, lambda x: _get(x, "$")), lambda x: x.isNotNull()))


def _range(v: Column) -> Column:
    """Alternatives of a version joined; * where there is none."""
    return F.coalesce(F.nullif(F.array_join(_texts(v), " || "), F.lit("")), F.lit("*"))


def _dependency(id_: Column, range_: Column, optional: Column) -> Column:
    return F.struct(id_.alias("id"), range_.alias("range"), optional.alias("optional"))


def _dependencies(name: Column, whole: Column, m: Column) -> Column:
    """Array of (id, range, optional) that project m of a descriptor declares."""
    map_ = lambda v, path: F.coalesce(F.try_variant_get(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    list_ = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    child = lambda x, path: F.try_variant_get(x, path, "variant")
    no = F.lit(False)
    fabric = F.transform(F.map_entries(map_(m, "$.depends")), lambda e: _dependency(e["key"], _range(e["value"]), no))
    # Versions of a Quilt dependency may be an object {"any": […]}, whose first list counts.
    versions = lambda x: F.coalesce(F.get(F.map_values(F.try_variant_get(x, "$.versions", "map<string,variant>")), F.lit(0)), child(x, "$.versions"))
    quilt = F.transform(list_(m, "$.depends"), lambda x: _dependency(F.coalesce(_get(x, "$"), _get(x, "$.id")), _range(versions(x)), no))
    kind = lambda x: F.coalesce(F.lower(_get(x, "$.type")) != "required", no)
    mandatory = lambda x: F.coalesce((F.schema_of_variant(child(x, "$.mandatory")) == "BOOLEAN") & ~F.try_variant_get(x, "$.mandatory", "boolean"), no)
    own = F.coalesce(F.try_element_at(map_(whole, "$.dependencies"), _get(m, "$.modId")), F.parse_json(F.lit("[]")))
    toml = F.transform(list_(own, "$"), lambda x: _dependency(_get(x, "$.modId"), F.coalesce(F.nullif(_get(x, "$.versionRange"), F.lit("")), F.lit("*")), mandatory(x) | kind(x)))
    required = _texts(child(m, "$.requiredMods"))
    legacy = F.transform(F.when(F.size(required) > 0, required).otherwise(_texts(child(m, "$.dependencies"))), lambda x: _dependency(x, F.lit("*"), no))
    found = F.when(name == "fabric.mod.json", fabric).when(name == "quilt.mod.json", quilt).when(name.endswith(".toml"), toml).otherwise(legacy)
    return F.filter(found, lambda x: F.coalesce(x["id"], F.lit("")) != "")


def _range_of(dependencies: Column, *ids: str) -> Column:
    """The range of the first of ids that is a dependency."""
    of = lambda i: F.get(F.filter(dependencies, lambda x: x["id"] == i), F.lit(0))["range"]
    return F.coalesce(*map(of, ids))


def _found(read: DataFrame) -> DataFrame:
    """The descriptors of each node: name, source_order, loader, text."""
    order = F.create_map(*[F.lit(x) for k, n in enumerate(R.DESCRIPTORS) for x in (n, k)])
    loader = F.create_map(*[F.lit(x) for pair in R.DESCRIPTORS.items() for x in pair])
    found = read.filter(F.col("name").isin(list(R.DESCRIPTORS)) & F.col("content").isNotNull() & (F.col("kind") == "entry"))
    text = found.groupBy(*NODE, "name").agg(F.min_by("content", "entry_seq").alias("content")).withColumn("text", _text(F.col("content")))
    return text.select(*NODE, "name", order[F.col("name")].alias("source_order"), loader[F.col("name")].alias("loader"), "text")


def _variants(text: DataFrame) -> DataFrame:
    """Descriptors in JSON and TOML with v, null where they cannot be parsed."""
    return text.filter("not endswith(name, '.yml')").withColumn("v", F.try_parse_json(F.when(F.col("name").endswith(".toml"), F.arrow_udf(_toml_as_json, "string")("text")).otherwise(F.col("text"))))


def unreadable(read: DataFrame) -> DataFrame:
    """Descriptors that declare nothing, as they cannot be parsed or have another shape: node, name."""
    declared = mods(read).select(*NODE, F.col("source_file").alias("name")).distinct()
    return _found(read).select(*NODE, "name").join(declared, [*NODE, "name"], "left_anti")


def mods(read: DataFrame) -> DataFrame:
    """Declared projects: node, source_order, source_file, loader, mod_seq, mod_id, mod_name, version, authors, entry_points,
    description, dependencies (id, range, optional), environment, mixins, minecraft_version, loader_version, mod_group (Quilt's).

    A descriptor that cannot be parsed declares nothing (unreadable() names it); fields of an unexpected type are null. A project of
    META-INF/mods.toml that depends on neoforge is one for NeoForge.
    """
    text = _found(read)
    json_ = _variants(text)
    several = F.when(F.col("name").endswith(".toml"), F.try_variant_get("v", "$.mods", "array<variant>")).when(
        F.col("name") == "mcmod.info", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.modList", "array<variant>"))
    ).otherwise(F.array(F.when(F.col("name") == "quilt.mod.json", F.try_variant_get("v", "$.quilt_loader", "variant")).otherwise(F.col("v"))))
    one = json_.filter("v is not null").select(*NODE, "name", "source_order", "loader", "v", F.posexplode(several).alias("mod_seq", "m"))
    m = F.col("m")
    # Exploded from a list of one, so that the many uses below do not each repeat the expression.
    one = one.filter(F.schema_of_variant(m).startswith("OBJECT")).select("*", F.explode(F.array(_dependencies(F.col("name"), F.col("v"), m))).alias("dependencies"))
    neoforge = (F.col("name") == "META-INF/mods.toml") & F.exists("dependencies", lambda x: x["id"] == "neoforge")
    declared = one.withColumn("loader", F.when(neoforge, "NeoForge").otherwise(F.col("loader"))).select(
        *NODE, "source_order", F.col("name").alias("source_file"), "loader", F.col("mod_seq").cast("long").alias("mod_seq"), F.coalesce(_get(m, "$.id"), _get(m, "$.modId"), _get(m, "$.modid")).alias("mod_id"),
        F.coalesce(_get(m, "$.name"), _get(m, "$.displayName"), _get(m, "$.metadata.name")).alias("mod_name"), _get(m, "$.version").alias("version"),
        F.concat(_list(m, "$.authors"), _list(m, "$.authorList"), F.slice(F.map_keys(F.coalesce(F.try_variant_get(m, "$.metadata.contributors", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), 1, ITEMS)).alias("authors"), _entry_points(m).alias("entry_points"),
        F.trim(F.coalesce(_get(m, "$.description"), _get(m, "$.metadata.description"))).alias("description"), "dependencies", _get(m, "$.environment").alias("environment"),
        F.transform(F.coalesce(F.try_variant_get(m, "$.mixins", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(_get(x, "$"), _get(x, "$.config"))).alias("mixins"),
        F.coalesce(_get(m, "$.mcversion"), _range_of(F.col("dependencies"), "minecraft")).alias("minecraft_version"),
        F.when(F.col("name").endswith(".toml"), F.coalesce(_range_of(F.col("dependencies"), "neoforge", "forge"), _get(F.col("v"), "$.loaderVersion"))).otherwise(_range_of(F.col("dependencies"), "fabricloader", "quilt_loader")).alias("loader_version"),
        F.when(F.col("name") == "quilt.mod.json", _get(m, "$.group")).alias("mod_group"),
    )
    plug = plugins(text.filter("endswith(name, '.yml')").withColumnRenamed("name", "source_file"), [*NODE, "source_order", "source_file", "loader"])
    needed = lambda names, optional: F.transform(names, lambda x: _dependency(x, F.lit("*"), F.lit(optional)))
    yaml = plug.select(
        *NODE, "source_order", "source_file", "loader", F.lit(0).cast("long").alias("mod_seq"), F.col("name").alias("mod_id"), F.col("name").alias("mod_name"), "version", "authors",
        F.array_compact(F.array("main")).alias("entry_points"), "description", F.concat(needed("needs", False), needed("wants", True)).alias("dependencies"), F.lit(None).cast("string").alias("environment"),
        F.array().cast("array<string>").alias("mixins"), F.col("api_version").alias("minecraft_version"), F.lit(None).cast("string").alias("loader_version"), F.lit(None).cast("string").alias("mod_group"),
    )
    return declared.withColumn("mixins", F.filter("mixins", lambda x: x.isNotNull())).unionByName(yaml)


def with_versions(mods: DataFrame, manifest_of: DataFrame) -> DataFrame:
    """mods whose version names the build's placeholder take the manifest's Implementation-Version, where there is one."""
    own = manifest_of.filter("key = 'Implementation-Version'").select(*NODE, F.col("value").alias("built"))
    placed = F.contains("version", F.lit("${file.jarVersion}")) & F.col("built").isNotNull()
    return mods.join(own, NODE, "left").withColumn("version", F.when(placed, F.col("built")).otherwise(F.col("version"))).drop("built")


def loaders(nodes: DataFrame, mods: DataFrame, manifest_of: DataFrame, classes: DataFrame) -> DataFrame:
    """node, loader: the one that descriptors name, several of them, or what the manifest or the classes suggest."""
    seen = mods.groupBy(*NODE, "loader").agg(F.min(F.struct("source_order", "mod_seq")).alias("first"))
    named = seen.groupBy(*NODE).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "loader"))), lambda x: x["loader"]).alias("names"))
    core = manifest_of.filter("key = 'FMLCorePlugin'").select(*NODE, F.lit(True).alias("core")).distinct()
    game = F.exists("class_refs", lambda r: r.startswith("net/minecraft/") | r.startswith("com/mojang/"))
    held = classes.groupBy(*NODE).agg(F.bool_or(F.coalesce(game, F.lit(False))).alias("game"))
    rows = nodes.select(*NODE).join(named, NODE, "left").join(core, NODE, "left").join(held, NODE, "left")
    loader = (
        F.when(F.size("names") == 1, F.col("names")[0])
        .when(F.size("names") > 1, F.concat(F.lit("Multi-loader ("), F.array_join("names", ", "), F.lit(")")))
        .when(F.col("core"), "Forge")
        .when(F.col("game"), "unknown (game code)")
        .when(F.col("game").isNotNull(), "unknown (Java classes)")
        .otherwise("unknown")
    )
    return rows.select(*NODE, loader.alias("loader"))
