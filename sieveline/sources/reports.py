"""What happened to each file, as tables, JSON lines or text. Reports name files, never their paths.

Every list in a report has a stated length, so a report is a row of bounded size; sections are aggregated by file and joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import safe_text
from sieveline.operators.capping import first_rows
from sieveline.operators.reports import severity_rank, severity_rollup
from sieveline.plans import inventory
from sieveline.plans.rules import inventory as notable_entries

DISCLAIMER = "Findings are evidence for a reader, not verdicts."
#: Items of each list in a report.
SHOWN = 50
EXTENSIONS, PACKAGES, ERRORS = 15, 10, 200
CLASSIFIED = {"VERIFIED": "checked before and trusted", "SUSPICIOUS": "checked before and flagged", "UNKNOWN": "not in the list, which says nothing against it"}
MARKS = {"INFO": "i", "REVIEW": "?", "WARNING": "!"}
#: Rules whose findings speak for a file.
POSITIVE = ["hash.verified"]


def confidence_label(severity: Column, confidence: Column) -> Column:
    """A fact (INFO) shows no confidence."""
    return F.when(severity == "INFO", "—").otherwise(confidence)


def severity_symbol(rule: Column, severity: Column) -> Column:
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    return F.when(rule.isin(POSITIVE), "✓").otherwise(marks[severity])


def ordered(findings: DataFrame) -> DataFrame:
    """findings with place: within a file worst first, then by rule and sequence."""
    order = Window.partitionBy("archive_id").orderBy(F.desc(severity_rank(F.col("severity"))), "node_path", "rule_order", "rule_id", "seq", "location", "title")
    return findings.withColumn("place", F.row_number().over(order).cast("long"))


def _gathered(rows: DataFrame, order: list, fields: list, name: str, most: int = SHOWN) -> DataFrame:
    """archive_id with `name`, the first `most` rows of each file as structs of fields, and n_`name`, how many there are."""
    counts = rows.groupBy("archive_id").agg(F.count("*").alias(f"n_{name}"))
    first = first_rows(rows, ["archive_id"], order, most).select("archive_id", "rn", F.struct(*fields).alias("x"))
    lists = first.groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "x"))), lambda r: r["x"]).alias(name))
    return counts.join(lists, "archive_id")


def sections(t, hashes: DataFrame | None = None) -> DataFrame:
    """archive_id with what the tables of plans.triage say of each file: validity and reason, classification, loader, projects, manifest, contents, classes, archives inside, errors."""
    top = t.nodes.filter("node_path = ''").select("archive_id", "sha256", "valid", F.col("message").alias("refused"))
    known = t.nodes.sparkSession.createDataFrame([], "sha256 string, classification string") if hashes is None else hashes.select("sha256", "classification")
    rated = lambda rows: rows.join(known.withColumnRenamed("sha256", "_sha"), F.col("sha256") == F.col("_sha"), "left").drop("_sha").withColumn("classification", F.coalesce("classification", F.lit("UNKNOWN")))
    loader = t.loaders.filter("node_path = ''").select("archive_id", "loader")
    mods = _gathered(t.mods, ["node_path", "source_order", "mod_seq"], ["node_path", "source_file", "loader", "mod_id", "mod_name", "version", "authors", "minecraft_version", "loader_version", "mod_group", F.slice("dependencies", 1, SHOWN).alias("dependencies"), F.substring("description", 1, 5000).alias("description")], "mods")
    manifest = _gathered(t.manifest.filter("node_path = ''"), ["position"], ["key", "value"], "manifest")
    own_entries, own_classes = t.entries.filter("node_path = ''"), t.classes.filter("node_path = ''")
    counts = inventory.counters(own_entries, own_classes).drop("node_path")
    lists = [inventory.top(x, value, most).withColumnRenamed("values", name) for x, value, most, name in (
        (inventory.extensions(own_entries), "extension", EXTENSIONS, "by_extension"), (inventory.java_versions(own_classes), "java_version", SHOWN, "java_versions"), (inventory.packages(own_classes), "package", PACKAGES, "packages"))]
    kinds = notable_entries(own_entries).select("archive_id", "entry_seq", "name", "size_bytes", "compressed_bytes", "magic", F.explode("kinds").alias("kind"))
    sizes = kinds.groupBy("archive_id", "kind").agg(F.count("*").alias("n"))
    first = first_rows(kinds, ["archive_id", "kind"], ["entry_seq"], SHOWN).groupBy("archive_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.struct("name", "size_bytes", "compressed_bytes", "magic").alias("x")))), lambda r: r["x"]).alias("entries"))
    notable = sizes.join(first, ["archive_id", "kind"]).groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("kind", "n", "entries"))).alias("notable"))
    ids = first_rows(t.mods.filter("mod_id is not null"), ["archive_id", "node_path"], ["source_order", "mod_seq"], SHOWN).groupBy("archive_id", "node_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "mod_id"))), lambda r: r["mod_id"]).alias("mod_ids"))
    inner = rated(t.nodes.filter("node_path <> ''")).join(t.loaders, ["archive_id", "node_path"], "left").join(ids, ["archive_id", "node_path"], "left")
    nested = _gathered(inner, ["node_path"], ["node_path", "size_bytes", "sha256", "classification", F.when(F.col("valid"), F.col("loader")).alias("loader"), "mod_ids", F.col("message").alias("error")], "nested")
    # Errors of archives inside are told at their file, under their path.
    said = F.concat(F.when(F.col("node_path") != "", F.concat(F.replace("node_path", F.lit("!/"), F.lit(" → ")), F.lit(": "))).otherwise(""), F.when(F.col("entry") != "", F.concat("entry", F.lit(": "))).otherwise(""), "message")
    errors = _gathered(t.errors, ["node_path", "stage", "entry"], ["stage", safe_text(said, 2000).alias("message")], "errors", ERRORS)
    parts = [loader, mods, manifest, counts, *lists, notable, nested, errors]
    out = reduce(lambda a, b: a.join(b, "archive_id", "left"), parts, rated(top).drop("sha256"))
    if t.rule_errors:  # told at every file, as every file lacks these rules' findings
        failed = F.array(*[F.struct(F.lit("rules").alias("stage"), F.lit(message).alias("message")) for _, message in t.rule_errors])
        out = out.withColumns({"errors": F.concat(F.coalesce("errors", F.array().cast("array<struct<stage:string,message:string>>")), failed), "n_errors": F.coalesce("n_errors", F.lit(0)) + len(t.rule_errors)})
    return out


def summary(valid: Column, refused: Column, unread: Column, counted: Column) -> Column:
    """One sentence: what is to be looked at; of a file that is no readable archive, that nothing could be looked at."""
    said = F.coalesce(counted, F.lit("nothing to review"))
    some = F.when(unread > 0, F.concat(said, F.lit("; "), unread.cast("string"), F.lit(" entries could not be read"))).otherwise(said)
    return F.when(valid, some).otherwise(F.concat(F.lit("not analysed, the file could not be read as an archive: "), F.coalesce(refused, F.lit("no reason given"))))


def documents(files: DataFrame, findings: DataFrame, tables=None, hashes: DataFrame | None = None) -> DataFrame:
    """A row a file: its facts, what its sections say, counts by severity, summary and ordered findings. Findings are capped by rule, so a file's list is bounded.

    Without tables a report has the findings only; whether the file could be read is then not known, and it says so.
    """
    shown = ordered(findings).groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("place", "rule_id", "severity", "confidence", "title", "location", "context", "explanation", "rationale"))).alias("findings"))
    counts = severity_rollup(findings, ["archive_id"]).withColumnRenamed("summary", "counted")
    out = files.drop("content").join(counts, "archive_id", "left").join(shown, "archive_id", "left").fillna(0, ["n_info", "n_review", "n_warning"])
    if tables is None:
        return out.withColumn("summary", F.coalesce("counted", F.lit("no finding; whether the file could be read is not said here"))).drop("counted").withColumn("disclaimer", F.lit(DISCLAIMER))
    of = out.join(sections(tables, hashes), "archive_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return of.withColumns({"summary": summary(F.col("valid"), F.col("refused"), F.coalesce("unread", F.lit(0)), F.col("counted")), "disclaimer": F.lit(DISCLAIMER)}).drop("counted")


def _field(label: str, value: Column) -> Column:
    """A line of a section; nothing where there is no value."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {label}: "), safe_text(value, 2000)))


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _pairs(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(x["value"], F.lit(" "), _number(x["n"]))), ", ")


def _section(title: str, *lines: Column | tuple[Column]) -> Column:
    """A section's title and those of its lines that are there; what _list gives is many lines."""
    each = [x[0] if isinstance(x, tuple) else F.array(x) for x in lines]
    return F.concat(F.lit(f"{title}\n"), F.array_join(F.array_compact(F.concat(*each)), "\n"), F.lit("\n"))


def _list(items: Column, line: Callable[[Column], Column], count: Column | None = None) -> tuple[Column]:
    """Lines, one an item, and one more for those beyond (as an array, marked by a tuple)."""
    none = F.array().cast("array<string>")
    shown = F.coalesce(F.transform(items, line), none)
    if count is None:
        return (shown,)
    return (F.concat(shown, F.when(count > F.size(shown), F.array(F.concat(F.lit("    … and "), _number(count - F.size(shown)), F.lit(" more")))).otherwise(none)),)


def as_text(reports: DataFrame) -> DataFrame:
    """(archive_id, value): each report as plain text: file, list of known files, projects, manifest, contents, classes, archives inside, findings, errors. Findings come without the sections where reports have none."""
    c = F.col
    rated = lambda f: F.concat(F.lit("  "), severity_symbol(f["rule_id"], f["severity"]), F.lit(" "), f["severity"], F.lit("  "), f["title"], F.lit("\n      at: "), f["location"], F.lit("\n      confidence: "), confidence_label(f["severity"], f["confidence"]),
                               F.when(f["context"] != "", F.concat(F.lit("\n      context: "), f["context"])).otherwise(""), F.lit("\n      "), f["explanation"], F.lit(" "), f["rationale"])
    head = F.concat(F.lit("FILE "), safe_text(c("file_name")), F.lit("\nSHA-256 "), F.coalesce("sha256", F.lit("-")), F.lit("\n"), F.concat_ws(", ", *[F.concat(_number(c(f"n_{s.lower()}")), F.lit(f" {s}")) for s in ("WARNING", "REVIEW", "INFO")]), F.lit("\n"), safe_text(c("summary"), 2000), F.lit("\n"))
    findings = _section("FINDINGS", _list(F.slice(c("findings"), 1, SHOWN), rated, F.size(c("findings"))))
    parts = [head]
    if "valid" in reports.columns:
        known = F.create_map(*[F.lit(x) for pair in CLASSIFIED.items() for x in pair])
        modified = [_field("modified", c("modified"))] if "modified" in reports.columns else []
        mod = lambda m: F.concat_ws("\n", F.concat(F.lit("  * "), safe_text(F.coalesce(m["mod_name"], m["mod_id"], F.lit("(unnamed)"))), F.lit(" ["), m["loader"], F.lit(", "), m["source_file"], F.lit("]"), F.when(m["node_path"] != "", F.concat(F.lit(" inside "), safe_text(m["node_path"]))).otherwise("")),
                                    _field("  id", m["mod_id"]), _field("  group", m["mod_group"]), _field("  version", m["version"]), _field("  authors", F.array_join(m["authors"], ", ")), _field("  game", m["minecraft_version"]), _field("  loader version", m["loader_version"]),
                                    _field("  needs", F.array_join(F.transform(m["dependencies"], lambda d: F.concat_ws(" ", d["id"], d["range"])), ", ")), _field("  description", m["description"]))
        entry = lambda e: F.concat(F.lit("      "), safe_text(e["name"]), F.lit(" ("), _number(e["size_bytes"]), F.lit(" bytes, "), _number(e["compressed_bytes"]), F.lit(" compressed)"))
        kind = lambda k: F.concat(F.lit("    "), F.replace(k["kind"], F.lit("_"), F.lit(" ")), F.lit(" ("), _number(k["n"]), F.lit(")\n"), F.array_join(F.transform(k["entries"], entry), "\n"))
        inner = lambda n: F.concat_ws("\n", F.concat(F.lit("  * "), safe_text(n["node_path"])), _field("  size", F.concat(_number(n["size_bytes"]), F.lit(" bytes"))), _field("  SHA-256", n["sha256"]), _field("  known", n["classification"]), _field("  loader", n["loader"]), _field("  ids", F.array_join(n["mod_ids"], ", ")), _field("  error", n["error"]))
        files = F.concat(_number(c("entries")), F.lit(" ("), _number(c("files")), F.lit(" files, "), _number(c("directories")), F.lit(" folders)"))
        classes = F.concat(_number(c("classes")), F.lit(" in all, "), _number(c("parsed")), F.lit(" parsed, "), _number(c("failed")), F.lit(" invalid, "), _number(c("skipped")), F.lit(" skipped"))
        parts += [
            _section("ABOUT", _field("size", F.concat(_number(c("size_bytes")), F.lit(" bytes"))), *modified, _field("type", c("file_type")), _field("readable archive", F.when(c("valid"), "yes").otherwise("no")), _field("known", F.concat(c("classification"), F.lit(": "), known[c("classification")]))),
            _section("PROJECTS", _field("loader", c("loader")), _list(c("mods"), mod, c("n_mods")), F.when(c("mods").isNull(), "  (no descriptor)")),
            _section("MANIFEST", _list(c("manifest"), lambda m: F.concat(F.lit("  "), safe_text(m["key"]), F.lit(": "), safe_text(m["value"], 2000)), c("n_manifest")), F.when(c("manifest").isNull(), "  (none)")),
            _section("CONTENTS", _field("entries", files), _field("declared size", F.concat(_number(c("declared_bytes")), F.lit(" bytes"))), _field("by extension", _pairs(c("by_extension"))), _list(c("notable"), kind)),
            _section("CLASSES", _field("class files", classes), _field("compiled for", _pairs(c("java_versions"))), _field("packages", _pairs(c("packages")))),
            F.when(c("nested").isNotNull(), _section("ARCHIVES INSIDE", _list(c("nested"), inner, c("n_nested")))).otherwise(""),
        ]
        findings = F.concat(findings, _section("ERRORS", _list(c("errors"), lambda e: F.concat(F.lit("  - "), e["message"]), c("n_errors")), F.when(c("errors").isNull(), "  (none)")))
    return reports.select("archive_id", F.concat(*parts, findings, c("disclaimer")).alias("value"))


def write_report(reports: DataFrame, path: str, kind: str) -> None:
    """kind: parquet, json or txt. An existing path is refused."""
    if kind == "parquet":
        reports.write.parquet(path)
    elif kind == "json":
        reports.write.json(path)
    elif kind == "txt":
        as_text(reports).select("value").write.text(path)
    else:
        raise ValueError(f"no such kind of report: {kind}")
