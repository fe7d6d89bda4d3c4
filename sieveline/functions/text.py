"""Column functions over names, paths and untrusted text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECEPTIVE = r"[​-‏‪-‮⁠⁦-⁩؜﻿]"


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, "[^/]*$", 0)


def extension_of(name: Column) -> Column:
    """Last extension in lower case with its dot; none for names that only begin with dots."""
    return F.lower(F.regexp_extract(base_name(name), r"^\.*[^.].*(\.[^.]*)$", 1))


def is_unsafe_path(name: Column) -> Column:
    """Absolute, with backslashes or a drive letter, or climbing out of its folder."""
    return name.startswith("/") | F.contains(name, F.lit("\\")) | name.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(name, "/"), "..")


def has_deceptive_chars(text: Column) -> Column:
    return text.rlike(DECEPTIVE)


def safe_text(text: Column, most: int = 300, newlines: bool = False) -> Column:
    """Text fit to show: cut with a mark, tabs as spaces, control and format characters replaced; null is empty."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…[truncated]"))).otherwise(text)
    kept = r"[\p{C}&&[^\n]]" if newlines else r"\p{C}"
    return F.coalesce(F.regexp_replace(F.translate(cut, "\t", " "), kept, "�"), F.lit(""))


def top_package(name: Column) -> Column:
    """First two package names of a class name with slashes."""
    parts = F.split(name, "/")
    n = F.size(parts)
    return F.when(n == 1, "(default package)").when(n == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def java_version_label(major: Column) -> Column:
    return F.when(major >= 49, F.concat(F.lit("Java "), (major - 44).cast("string"))).otherwise(F.concat(F.lit("Java 1."), (major - 44).cast("string")))


def simple_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "/", -1), "$", 1)


def first_word(text: Column) -> Column:
    """The first run of signs without white space; empty where there is none."""
    return F.regexp_extract(text, r"(?U)\S+", 0)


def command_name(token: Column, shells: list[str]) -> Column:
    """A command without quotes and folder; shells stay as they are written."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(token), "^[\"']+|[\"']+$", "")))
    return F.when(bare.isin(shells), bare).otherwise(F.regexp_extract(F.replace(bare, F.lit("\\"), F.lit("/")), "[^/]*$", 0))


def normalized_sha256(text: Column) -> Column:
    """A SHA-256 in lower case, or null."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for empty text. For literals: its work is length times distinct characters (functions.entropy reads texts of any length once)."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    shares = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text).cast("double"))
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(text) > 0, bits).otherwise(F.when(text.isNotNull(), 0.0))


def try_base64(text: Column) -> Column:
    """Bytes of standard or URL-safe base64 with or without padding; null for anything else."""
    std = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.concat(std, F.repeat(F.lit("="), F.pmod(-F.length(std), F.lit(4)))), F.lit("base64"))


def magic_of(data: Column, magics: dict[str, str]) -> Column:
    """What the first bytes say: the first of magics (hex prefix -> name) that fits."""
    head = F.hex(F.substring(data, 1, 8))
    found = F.when(F.length(data) == 0, "empty file")
    for prefix, name in magics.items():
        found = found.when(head.startswith(prefix), name)
    return found.otherwise("unknown")


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def skeleton(name: Column) -> Column:
    """A normalised name with look-alike signs folded."""
    return F.translate(F.replace(F.replace(name, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), "013547i", "olesatl")
