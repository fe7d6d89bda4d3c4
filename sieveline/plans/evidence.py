"""What each class does, from its constants: tags, addresses, sensitive fragments, encoded literals, commands.

One row a class, all of it built-in expressions: nothing is shuffled and no Python runs.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.functions import text as T
from sieveline.functions import urls as U
from sieveline.operators.lookup import exact_else_prefix, exact_else_wildcard

_BASE64 = r"\A[A-Za-z0-9+/_-]{40,}={0,2}\z"
_PAYLOADS = ["Java class file (or Mach-O universal binary)", "Windows executable (PE)", "ZIP/JAR archive", "Linux executable (ELF)"]
FRAGMENTS = {f: category for category, fragments in R.SENSITIVE.items() for f in fragments}
_SENSITIVE = "(?iu)" + "|".join(re.escape(f).replace("/", "/") for f in FRAGMENTS)


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


def _tag(condition: Column, *names: str) -> Column:
    return F.when(condition, _lits(names)).otherwise(F.array().cast("array<string>"))


def _flat(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def _fragments(text: Column) -> Column:
    """Sensitive fragments of a text in lower case; letters that only look folded are folded first."""
    folded = F.translate(text, "ſK", "sk")
    return F.transform(F.regexp_extract_all(folded, F.lit(_SENSITIVE), F.lit(0)), lambda x: F.lower(x))


#: What follows a place when the literal was found inside an encoded one.
DECODED = " (Base64-decoded string)"
_NO_FACTS = "array<struct<kind:string,item:string,at:int,decoded:boolean>>"


def _fact(kind: str, item: Column, at: Column, decoded: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.alias("item"), at.alias("at"), F.lit(decoded).alias("decoded"))


def _of_text(text: Column, at: Column, decoded: bool) -> Column:
    """What one text holds, in this order: addresses, addresses with ports, sensitive fragments, class names that matter, game features."""
    all_ = lambda kind, items: F.transform(items, lambda x: _fact(kind, x, at, decoded))
    one = lambda kind, when, item: F.when(when, F.array(_fact(kind, item, at, decoded))).otherwise(F.array().cast(_NO_FACTS))
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    parts = F.concat(
        all_("url", U.urls_in(text)), all_("ip", U.ip_ports_in(text)), all_("fragment", _fragments(text)),
        one("target", text.isin(R.REFLECTION_TARGETS), text), one("cheat", letters.isin(R.CHEAT_WORDS), T.safe_text(text, 100)),
    )
    return F.coalesce(parts, F.array().cast(_NO_FACTS))


def _facts(literals: Column) -> Column:
    """Facts of a class's literals, in the order in which they stand there: kind, item, the literal's number, and whether it was decoded from the literal.

    A literal of base64 gives a payload if its bytes begin like a program or archive, else what the text in it holds.
    """
    none = F.array().cast(_NO_FACTS)
    # Step by step, so that each is evaluated once a literal.
    read = F.transform(literals, lambda s, k: F.struct(k.alias("at"), s.alias("text"), F.when(s.rlike(_BASE64), T.try_base64(s)).alias("data")))
    told = F.transform(read, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), x["data"].alias("data"), F.when(x["data"].isNotNull(), T.magic_of(x["data"], R.MAGIC)).alias("magic")))
    plain = F.transform(told, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), F.when(x["magic"].isin(_PAYLOADS), x["magic"]).alias("payload"), F.when(~x["magic"].isin(_PAYLOADS), F.call_function("make_valid_utf8", x["data"].cast("string"))).alias("inner")))
    legible = lambda t: F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit(""))) < F.length(t) * 0.1

    def facts(x: Column) -> Column:
        text, at = x["text"], x["at"]
        mixed = text.rlike(_BASE64) & text.rlike("[a-z]") & text.rlike("[A-Z]") & text.rlike("[0-9]")
        bits = F.when(mixed, T.shannon_entropy(text))
        preview = F.concat(F.substring(text, 1, 60), F.when(F.length(text) > 60, "…").otherwise(""), F.lit(" (entropy "), F.format_number(bits, 2), F.lit(")"))
        encoded = F.when(bits >= F.when(F.length(text) < 100, 4.5).otherwise(5.0), F.array(_fact("encoded", preview, at))).otherwise(none)
        payload = F.when(x["payload"].isNotNull(), F.array(_fact("payload", x["payload"], at))).otherwise(none)
        return F.concat(_of_text(text, at, False), encoded, payload, F.when(legible(x["inner"]), _of_text(x["inner"], at, True)).otherwise(none))

    return F.flatten(F.transform(plain, facts))


def literal_facts(evidence: DataFrame) -> DataFrame:
    """Facts as a table: node, class (entry_seq, entry_name, tags), place among the class's facts, literal, kind, item, decoded, and `where`: the class and how the literal was read."""
    rows = evidence.select("archive_id", "node_path", "entry_seq", "entry_name", "tags", F.posexplode("facts").alias("place", "f"))
    where = F.concat("entry_name", F.when(F.col("f.decoded"), DECODED).otherwise(""))
    return rows.select("archive_id", "node_path", "entry_seq", "entry_name", "tags", "place", F.col("f.at").alias("literal"), "f.kind", "f.item", "f.decoded", where.alias("where"))


def class_evidence(classes: DataFrame) -> DataFrame:
    """Parsed classes with tags, facts of their literals, and of these urls, hidden_urls, ip_ports, fragments, targets, cheats, encoded, payloads, and the commands by kind (helpers, shells, risky, programs)."""
    c = classes.filter("status = 'parsed'")
    literals = F.col("strings")
    c = c.withColumn("facts", _facts(literals))
    of = lambda kind, decoded=None: F.transform(F.filter("facts", lambda x: (x["kind"] == kind) & (F.lit(True) if decoded is None else x["decoded"] == decoded)), lambda x: x["item"])
    c = c.withColumns({
        "payloads": of("payload"), "encoded": of("encoded"), "urls": F.array_distinct(of("url", False)), "hidden_urls": F.array_distinct(of("url", True)),
        "ip_ports": F.array_distinct(of("ip")), "fragments": F.array_distinct(of("fragment")), "targets": F.array_distinct(of("target")), "cheats": F.array_distinct(of("cheat")),
        "commands": F.array_sort(F.array_distinct(F.transform(F.filter(literals, lambda s: F.length(s) <= 300), lambda s: T.command_name(T.first_word(s), R.SHELL_COMMANDS)))),
        "flags": F.filter(_lits(R.HIDDEN_FLAGS), lambda f: F.exists(literals, lambda s: F.contains(F.lower(s), f))),
    })
    kinds = {"helpers": R.HELPER_COMMANDS, "shells": R.SHELL_COMMANDS, "risky": R.RISKY_COMMANDS}
    named = [x for names in kinds.values() for x in names]
    other = F.filter("commands", lambda s: s.endswith(".exe") & (F.length(s) > 4) & (F.length(s) < 60) & ~s.isin(named))
    among = lambda names: F.filter("commands", lambda s: s.isin(names))
    c = c.withColumns({**{kind: F.slice(among(names), 1, 10) for kind, names in kinds.items()}, "programs": F.slice(other, 1, 10)}).drop("commands")
    refs, members = F.col("class_refs"), F.col("member_refs")
    owner, member = (lambda m: F.substring_index(m, "#", 1)), (lambda m: F.substring_index(m, "#", -1))
    category = F.create_map(*[F.lit(x) for x in chain(*FRAGMENTS.items())])
    groups = F.array_compact(F.transform(refs, lambda r: exact_else_prefix(r, R.API_CLASSES, R.API_PACKAGE_PREFIXES)))
    calls = F.array_compact(F.transform(members, lambda m: exact_else_wildcard(owner(m), member(m), R.API_MEMBERS)))
    categories = F.transform("fragments", lambda f: category[f])
    descriptors = F.size(F.filter(literals, lambda s: s.rlike(r"\A" + R.DESCRIPTOR + r"\z")))
    token = F.exists(members, lambda m: member(m).isin(R.SESSION_TOKEN_MEMBERS) & owner(m).rlike("^(" + "|".join(R.SESSION_TOKEN_OWNERS) + ")"))
    programs = F.exists(literals, lambda s: (F.length(s) <= 300) & F.lower(s).rlike("(" + "|".join(re.escape(e) for e in R.PROGRAM_EXTENSIONS) + r")(?U:\s*)\z"))
    tags = [
        groups, calls,
        _tag(F.col("super_name").isin(R.CLASSLOADER_SUPERCLASSES), "dynamic_loading"),
        _tag(F.arrays_overlap(refs, _lits(R.FILE_WRITE_CLASSES)) | F.arrays_overlap(members, _lits(R.FILE_WRITE_MEMBERS)), "file_write"),
        _tag(F.arrays_overlap(members, _lits(R.NATIVE_FILE_LOAD_MEMBERS)), "native_file_load"),
        _tag(token, "session_token"), _tag(programs, "exec_content"), _tag(F.size("flags") > 0, "hidden_exec"),
        _tag(F.exists(refs, lambda r: r.rlike(R.BYTECODE_LIBRARY)) | (descriptors >= 3), "bytecode_gen"),
        _tag(F.size("hidden_urls") > 0, "encoded_url"), _tag(F.size("payloads") > 0, "encoded_payload"),
        _tag(F.arrays_overlap(categories, _lits(R.HIGH_RISK_CATEGORIES)), "sensitive_high"),
        _tag(F.array_contains(categories, R.PERSISTENCE_CATEGORY), "persistence"), _tag(F.array_contains(categories, R.SHELL_CATEGORY), "shell"),
    ]
    out = c.withColumns({"tags": F.array_sort(F.array_distinct(F.concat(*tags))), "categories": F.array_sort(F.array_distinct(categories))})
    own = F.filter(refs, lambda r: r.startswith("com/sun/jna/"))
    out = out.withColumn("bindings", F.array_sort(own))
    rated = lambda name: F.transform(name, lambda u: F.struct(u.alias("url"), U.classify_url(u).alias("v")))
    return out.withColumns({"rated_urls": rated("urls"), "rated_hidden": rated("hidden_urls")}).drop("strings")
