"""Files made to break the reader: no task fails, and reports say what could not be read."""

import io
import json
import random
import zipfile

import pytest

from sieveline import __main__ as cli
from sieveline.limits import Limits
from sieveline.plans import inventory, rules
from sieveline.plans.evidence import class_evidence
from sieveline.plans.triage import decoded, findings_of
from sieveline.sources import archives
from sieveline.sources.build import packed, pieces
from sieveline.sources.reports import as_text, documents, write_report
from tests.archives import class_bytes, jar
from tests.test_triage import EXEC, FABRIC, LOAD, NET, files

KINDS = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]


def whole(compression):
    inner = jar({"in/A.class": class_bytes("in/A"), "x.txt": "y" * 50}, compression)
    return jar({"META-INF/MANIFEST.MF": b"Manifest-Version: 1.0\n", "fabric.mod.json": FABRIC, "p/A.class": class_bytes("p/A", strings=["s" * 300]), "pic.png": b"\x89PNG" + bytes(100), "inner.jar": inner}, compression)


def flipped(data, rng, n):
    out = bytearray(data)
    for _ in range(n):
        out[rng.randrange(len(out))] ^= 1 << rng.randrange(8)
    return bytes(out)


@pytest.mark.parametrize("compression", KINDS)
def test_no_byte_fails_the_reader(compression):
    rng, data = random.Random(compression), whole(compression)
    broken = [flipped(data, rng, rng.choice([1, 1, 2, 8, 60])) for _ in range(700)] + [data[:k] for k in range(0, len(data), 37)]
    seen = set()
    for x in broken:
        rows = list(archives._node("a", "", 0, x, archives._Budget(1 << 20), Limits(max_total_decompressed=1 << 20)))
        assert rows[0]["kind"] == "node"
        seen |= {r.get("message") for r in rows}
        for r in rows:
            if r["kind"] == "entry" and r["content"] is not None and r["name"].endswith(".class"):
                try:
                    archives.class_file(r["content"])
                except ValueError:
                    pass
    assert any(m and m.startswith("unreadable entry") for m in seen)


def damaged(entry, compression):
    """An archive in which one entry's data begins with bytes that its method cannot read."""
    data = bytearray(whole(compression))
    info = zipfile.ZipFile(io.BytesIO(bytes(data))).getinfo(entry)
    at = info.header_offset + 30 + len(entry)
    data[at : at + min(12, info.compress_size)] = b"\xff" * min(12, info.compress_size)
    return bytes(data)


@pytest.fixture(scope="module")
def hostile(spark):
    named = {
        "fake.jar": b"PK\x03\x04 this is no archive at all", "text.jar": b"hello", "empty.jar": b"", "good.jar": whole(zipfile.ZIP_DEFLATED),
        "lzma.jar": damaged("p/A.class", zipfile.ZIP_LZMA), "bz.jar": damaged("p/A.class", zipfile.ZIP_BZIP2), "pic.jar": damaged("pic.png", zipfile.ZIP_DEFLATED),
        "run.jar": jar({"p/A.class": class_bytes("p/A", calls=NET + LOAD + EXEC), "lib/bad.jar": b"PK\x03\x04 no", "big.txt": "x" * 9}), "many.jar": jar([(f"d/{k}.bin", bytes(range(200))) for k in range(40)]),
    }
    many = bytearray(named["many.jar"])
    for info in zipfile.ZipFile(io.BytesIO(bytes(many))).infolist():
        many[info.header_offset + 30 + len(info.filename)] = 0xFF
    named["many.jar"] = bytes(many)
    t = decoded(files(spark, named))
    known = spark.createDataFrame([(t.files.filter("archive_id = 'fake.jar'").first().sha256, "SUSPICIOUS")], "sha256 string, classification string")
    found = findings_of(t, known)
    return t, found, documents(t.files, found, t, known)


def test_reports_tell_what_could_not_be_read(hostile):
    t, found, reports = hostile
    rows = {r.archive_id: r for r in reports.collect()}
    refused = "not analysed, the file could not be read as an archive: "
    assert {k: rows[k].summary for k in ("fake.jar", "text.jar", "empty.jar")} == {"fake.jar": refused + "no end record", "text.jar": refused + "not an archive", "empty.jar": refused + "not an archive"}
    assert [rows[k].valid for k in ("fake.jar", "good.jar", "lzma.jar")] == [False, True, True]
    assert rows["good.jar"].summary == "3 items to review" and rows["good.jar"].n_errors is None
    assert rows["pic.jar"].summary.endswith("; 1 entries could not be read") and rows["pic.jar"].errors[0].message.startswith("pic.png: unreadable entry")
    assert {(r.archive_id, r.status) for r in t.classes.filter("node_path = '' and archive_id in ('lzma.jar', 'bz.jar')").collect()} == {("lzma.jar", "failed"), ("bz.jar", "failed")}
    assert rows["many.jar"].unread == 40 and rows["many.jar"].n_errors == 20
    assert [e.message for e in rows["run.jar"].errors] == ["lib/bad.jar: no end record"]
    assert rows["fake.jar"].classification == "SUSPICIOUS" and {f.rule_id for f in rows["fake.jar"].findings} == {"hash.suspicious"}
    text = {r.archive_id: r.value for r in as_text(reports).collect()}
    assert "readable archive: no" in text["fake.jar"] and "no end record" in text["fake.jar"] and "known: SUSPICIOUS" in text["fake.jar"]
    assert "unreadable entry" in text["pic.jar"].partition("ERRORS")[2]


def test_reports_have_all_sections(spark, hostile, tmp_path):
    _, _, reports = hostile
    r = {x.archive_id: x for x in reports.collect()}["good.jar"]
    assert (r.entries, r.files, r.directories, r.classes, r.parsed, r.failed, r.loader) == (5, 5, 0, 1, 1, 0, "Fabric")
    assert [(m.mod_id, m.version, m.authors) for m in r.mods] == [("plain", "1.0", ["a", "b"])] and [(m.key, m.value) for m in r.manifest] == [("Manifest-Version", "1.0")]
    assert [(x.value, x.n) for x in r.java_versions] == [("Java 17", 1)] and [x.value for x in r.packages] == ["p"] and {x.value for x in r.by_extension} == {".mf", ".json", ".class", ".png", ".jar"}
    assert [(n.node_path, n.classification, n.error) for n in r.nested] == [("inner.jar", "UNKNOWN", None)]
    assert [(k.kind, k.n, k.entries[0].name) for k in r.notable] == [("nested_jars", 1, "inner.jar")]
    text = {x.archive_id: x.value for x in as_text(reports).collect()}["good.jar"]
    heads = ["FILE good.jar", "ABOUT", "PROJECTS", "MANIFEST", "CONTENTS", "CLASSES", "ARCHIVES INSIDE", "FINDINGS", "ERRORS"]
    places = [text.index(h) for h in heads]
    assert places == sorted(places)
    for line in ("  * Plain [Fabric, fabric.mod.json]", "  authors: a, b", "  entries: 5 (5 files, 0 folders)", "  compiled for: Java 17 1", "    nested jars (1)", "  Manifest-Version: 1.0", "confidence: "):
        assert line in text, line
    write_report(reports, str(tmp_path / "r.json"), "json")
    assert {x.archive_id for x in spark.read.json(str(tmp_path / "r.json")).filter("valid").collect()} >= {"good.jar", "run.jar"}


def test_a_rule_that_fails_costs_only_itself(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES", dict(rules.RULES))

    @rules.registered("unplannable")
    def _(subjects):
        return subjects.nodes.select("no_such_column")

    @rules.registered("breaks_off")
    def _(subjects):
        return subjects.nodes.selectExpr("archive_id", "node_path", "0L seq", "'own.x' rule_id", "raise_error('on purpose') severity", "'LOW' confidence", "'' title", "'' location", "'' context")

    @rules.registered("own")
    def _(subjects):
        return subjects.nodes.selectExpr("archive_id", "node_path", "0L seq", "'own.node' rule_id", "'INFO' severity", "'LOW' confidence", "name title", "'(archive)' location", "'' context")

    t = decoded(files(spark, {"a": jar({"p/A.class": class_bytes("p/A", calls=NET + LOAD)})}))
    found = findings_of(t)
    got = {r.rule_id for r in found.collect()}
    assert {"own.node", "combo.downloader", "metadata.none"} <= got and "own.x" not in got
    assert [name for name, _ in t.rule_errors] == ["unplannable", "breaks_off"] and "on purpose" in t.rule_errors[1][1]
    r = documents(t.files, found, t).first()
    assert [e.stage for e in r.errors] == ["rules", "rules"] and r.n_errors == 2 and "rules breaks_off" in as_text(documents(t.files, found, t)).first().value
    only = {r.rule_id for r in findings_of(t, only=["metadata"]).collect()}
    assert only == {"metadata.none"}


def test_inventory_tables(spark):
    toml = '[[mods]]\nmodId="first"\nversion="2"\n[[mods]]\nmodId="second"\n'
    data = jar({"META-INF/mods.toml": toml, "mcmod.info": '[{"modid": "old"}]', "a/b/C.class": class_bytes("a/b/C", refs=["com/sun/jna/platform/win32/User32$Msg", "com/sun/jna/platform/win32/Kernel32", "com/sun/jna/platform/win32/User32", "com/sun/jna/Pointer"]), "a/b/D.class": class_bytes("a/b/D", major=52), "bad.class": b"\xca\xfe\xba\xbe", "d/": b"", "x.tar.gz": "z", "LICENSE": "t"})
    t = decoded(files(spark, {"a": data}))
    c = inventory.counters(t.entries, t.classes).first()
    assert (c.entries, c.files, c.directories, c.classes, c.parsed, c.failed, c.skipped, c.unread) == (8, 7, 1, 3, 2, 1, 0, 0)
    assert {(r.extension, r.n) for r in inventory.extensions(t.entries).collect()} == {(".toml", 1), (".info", 1), (".class", 3), (".gz", 1), ("(none)", 1)}
    assert {(r.java_version, r.n) for r in inventory.java_versions(t.classes).collect()} == {("Java 17", 1), ("Java 8", 1)}
    assert [(r.package, r.n) for r in inventory.packages(t.classes).collect()] == [("a/b", 2)]
    assert [(r.mod_id, r.version) for r in inventory.primary_projects(t.mods).collect()] == [("first", "2")]
    assert [(r.entry_name, r.bindings) for r in inventory.bindings(class_evidence(t.classes)).collect()] == [("a/b/C.class", ["Kernel32", "User32"])]


def test_words_of_any_length_are_packed(spark):
    long = "x" * 15_998 + "110.20.30.40" + "é" * 40_000 + "8.8.8.8-" + "y" * 70_000
    assert "".join(pieces(long)) == long and all(len(p.encode()) < 65_536 for p in pieces(long)) and len(pieces("1." * 20_000)) == 3
    rows = spark.createDataFrame([(1, "short words " + long), (2, None), (3, "z" * 100_000), (3, "w")], "doc_id long, text string").coalesce(1)
    t = decoded(packed(rows).union(packed(rows.filter("doc_id = 3"))).union(packed(rows.filter("text = 'w'"))))
    literals = [x for r in t.classes.filter("name = 'd/1_0'").collect() for x in r.strings]
    assert "".join(literals) == "shortwords" + long and any("110.20.30.40" in x for x in literals)
    assert t.files.select("archive_id").distinct().count() == 3


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in [1]"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jar").write_bytes(jar({"p/A.class": class_bytes("p/A", calls=NET + LOAD)}))
    (folder / "deep" / "b.jar").write_bytes(b"no archive")
    (folder / "c.bin").write_bytes(jar({"x.txt": "y"}))
    (tmp_path / "link.jar").symlink_to(folder / "a.jar")
    names = lambda paths, recursive=True: sorted(r.file_name for r in archives.scan_paths(spark, [str(p) for p in paths], recursive).collect())
    assert names([folder, folder / "a.jar", tmp_path / "link.jar", folder / "c.bin", folder / "deep"]) == ["a.jar", "b.jar", "c.bin"]
    assert names([folder], False) == ["a.jar"] and names([folder, folder / "deep" / "b.jar"], False) == ["a.jar", "b.jar"]
    assert cli.main([str(tmp_path / "gone")], spark) == 1 and "not found" in capsys.readouterr().err
    (tmp_path / "none").mkdir()
    assert cli.main([str(tmp_path / "none")], spark) == 1 and "no archives" in capsys.readouterr().err
    out = tmp_path / "out.json"
    assert cli.main([str(folder), "-r", "-q", "--json", str(out), "--hashes", str(tmp_path / "no list")], spark) == 0
    said = capsys.readouterr()
    assert said.out == "" and "left out" in said.err and "wrote json" in said.err
    reports = [json.loads(x) for p in out.glob("part-*") for x in p.read_text().splitlines()]
    assert {r["file_name"]: r["valid"] for r in reports} == {"a.jar": True, "b.jar": False}
    assert cli.main([str(folder / "a.jar")], spark) == 0 and "FILE a.jar" in capsys.readouterr().out
