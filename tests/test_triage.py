"""Archives end to end: decoding, evidence and graded findings."""

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from sieveline.limits import Limits
from sieveline.plans.evidence import class_evidence
from sieveline.plans.triage import decoded, findings_of, triage
from sieveline.sources import archives
from sieveline.sources.descriptors import loaders, mods, with_versions
from sieveline.sources.hash_list import as_document, read_hash_list, removed, upserted
from sieveline.sources.reports import as_text, documents, write_report
from sieveline.streaming.watch import watch
from tests.archives import class_bytes, jar

NET, EXEC, WRITE = [("java/net/URL", "openStream")], [("java/lang/Runtime", "exec")], ["java/io/FileOutputStream"]
LOAD, TOKEN = [("java/lang/ClassLoader", "defineClass")], [("net/minecraft/Session", "getAccessToken")]
FABRIC = json.dumps({"id": "plain", "version": "1.0", "name": "Plain", "authors": ["a", {"name": "b"}], "entrypoints": {"main": ["pkg.Main", {"value": "pkg.Gone::init"}]}})
#: case: (class arguments, expected {rule: (severity, confidence)} among these)
LADDER = {
    "network": (dict(calls=NET), {"api.network": ("INFO", "LOW")}, ["api.downloads", "combo.downloader"]),
    "write": (dict(calls=NET, refs=WRITE), {"api.downloads": ("REVIEW", "LOW")}, ["combo.downloader"]),
    "write_name": (dict(calls=NET, refs=WRITE, strings=["x.exe"]), {"api.downloads": ("REVIEW", "MEDIUM")}, ["combo.downloader"]),
    "load": (dict(calls=NET + LOAD), {"combo.downloader": ("WARNING", "MEDIUM")}, ["api.downloads"]),
    "load_name": (dict(calls=NET + LOAD, strings=["x.jar"]), {"combo.downloader": ("WARNING", "HIGH")}, []),
    "helper": (dict(calls=NET + EXEC, strings=["xdg-open"]), {"combo.downloader": ("REVIEW", "MEDIUM"), "api.process_execution": ("REVIEW", "LOW")}, []),
    "hidden": (dict(calls=EXEC, strings=["powershell -w hidden x"]), {"combo.hidden_execution": ("WARNING", "MEDIUM")}, []),
    "persist": (dict(calls=EXEC, strings=[r"Software\Microsoft\Windows\CurrentVersion\Run"]), {"combo.persistence_exec": ("WARNING", "HIGH")}, []),
    "decode": (dict(calls=LOAD + [("java/util/Base64", "getDecoder")]), {"combo.decoded_exec": ("WARNING", "MEDIUM")}, []),
    "theft": (dict(calls=NET, strings=["Local Storage/leveldb"]), {"combo.data_theft": ("WARNING", "HIGH"), "strings.sensitive": ("WARNING", "MEDIUM")}, []),
    "token": (dict(calls=NET + TOKEN), {"combo.session_token_network": ("REVIEW", "MEDIUM"), "api.session_token": ("REVIEW", "LOW")}, []),
    "token_url": (dict(calls=NET + TOKEN, strings=["https://pastebin.com/x"]), {"combo.session_token_network": ("WARNING", "HIGH"), "strings.url": ("REVIEW", "MEDIUM")}, []),
    "webhook": (dict(strings=["https://discord.com/api/v10/webhooks/12/ab-c"]), {"strings.url": ("WARNING", "HIGH")}, []),
    "known_url": (dict(strings=["see https://github.com/x."]), {"strings.urls_other": ("INFO", "LOW")}, ["strings.url"]),
    "payload": (dict(calls=LOAD, strings=[base64.b64encode(b"MZ" + bytes(60)).decode()]), {"strings.encoded_executable": ("WARNING", "HIGH"), "combo.packed_payload": ("WARNING", "HIGH")}, []),
    "hidden_url": (dict(strings=[base64.b64encode(b"go to https://pastebin.com/raw/abc now and wait there").decode()]), {"strings.encoded_url": ("REVIEW", "MEDIUM")}, []),
    "reflect": (dict(strings=["java.lang.Runtime"], calls=[("java/lang/Class", "forName")]), {"api.reflective_sensitive": ("REVIEW", "MEDIUM")}, []),
    "jndi": (dict(refs=["javax/naming/InitialContext"]), {"api.jndi": ("REVIEW", "MEDIUM")}, []),
    "ip": (dict(strings=["8.8.8.8:4444", "10.0.0.1:80"]), {"strings.ip_port": ("REVIEW", "LOW")}, []),
    "loader": (dict(super_name="java/net/URLClassLoader"), {"api.dynamic_loading": ("REVIEW", "LOW")}, []),
    "cheat": (dict(strings=["Kill-Aura"]), {"classes.cheat_feature_strings": ("REVIEW", "LOW")}, []),
}


def files(spark, named):
    return spark.createDataFrame([(n, n, len(d), bytearray(d)) for n, d in named.items()], "archive_id string, file_name string, size_bytes long, content binary")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.archive_id, []).append(r)
    return out


@pytest.fixture(scope="module")
def ladder(spark):
    named = {case: jar({"pkg/Main.class": class_bytes("pkg/Main", **args)}) for case, (args, _, _) in LADDER.items()}
    return found(findings_of(decoded(files(spark, named))))


@pytest.mark.parametrize("case", LADDER)
def test_ladder(ladder, case):
    _, want, never = LADDER[case]
    got = {r.rule_id: (r.severity, r.confidence) for r in ladder[case]}
    assert {k: got.get(k) for k in want} == want
    assert not set(never) & set(got)
    assert all(r.confidence == "LOW" for r in ladder[case] if r.severity == "INFO")


def test_contents_and_metadata(spark):
    inner = jar({"in/Bad.class": class_bytes("in/Bad", calls=EXEC, strings=["powershell -w hidden"]), "plain.txt": "x"})
    big = jar([
        ("META-INF/MANIFEST.MF", b"Manifest-Version: 1.0\r\nMain-Class: pkg.\r\n Main\r\nPremain-Class: pkg.Agent\r\nMain-Class: pkg.Last\r\n\r\nName: x\r\nFMLCorePlugin: no\r\n"),
        ("fabric.mod.json", FABRIC), ("META-INF/mods.toml", '[[mods]]\nmodId="sodlum"\nversion="2"\ndisplayName="S"\n[[mods]]\nmodId="second"\n'),
        ("pkg/Main.class", class_bytes("pkg/Main")), ("pkg/Main.class", class_bytes("pkg/Main")), ("pkg/Broken.class", b"\xca\xfe\xba\xbe\x00"), ("a/lIl1.class", class_bytes("b/lIl1")),
        ("lib/inner.jar", inner), ("lib/broken.jar", b"PK\x03\x04 no"), ("pic.png", b"MZ" + bytes(20)), ("data.bin", jar({"x": "y"})), ("run.exe", b"MZ" + bytes(9)), ("../up.txt", "x"), ("zeros.txt", bytes(2 << 20)), ("Stealer.txt", "x" * 9), ("odd.qqq", "x" * 9), ("name‮.txt", "x" * 9),
    ])
    named = {"big.jar": big, "twin.jar": jar({"fabric.mod.json": FABRIC}), "bad.jar": b"no archive", "cut.jar": big[: len(big) // 2], "empty.jar": b""}
    t = decoded(files(spark, named))
    got = found(findings_of(t))
    rules = {}
    for r in got["big.jar"]:
        rules.setdefault(r.rule_id, []).append((r.severity, r.location))
    for rule in (
        "manifest.main_class", "manifest.java_agent", "metadata.detected", "metadata.incomplete", "metadata.inconsistent_id", "metadata.inconsistent_version", "metadata.missing_entrypoint", "metadata.lookalike", "contents.executables", "contents.disguised",
        "contents.hidden_archive", "contents.duplicates", "contents.unsafe_paths", "contents.deceptive_names", "contents.compression_ratio", "contents.nested_jars", "contents.unusual_files", "classes.invalid", "classes.name_mismatch", "classes.confusable_names", "classes.malware_names", "batch.duplicate_mod_id",
    ):
        assert rule in rules, rule
    assert "manifest.coremod" not in rules
    assert [loc for _, loc in rules["metadata.missing_entrypoint"]] == ["pkg.Gone::init"]
    assert ("WARNING", "lib/inner.jar → in/Bad.class") in rules["combo.hidden_execution"]
    assert not any(s == "INFO" and " → " in loc for rows in rules.values() for s, loc in rows)
    manifest = {r.key: r.value for r in t.manifest.collect()}
    assert manifest["Main-Class"] == "pkg.Last" and "FMLCorePlugin" not in manifest
    mods = sorted((r.archive_id, r.source_file, r.mod_id or "", r.version or "") for r in t.mods.collect())
    assert mods == [("big.jar", "META-INF/mods.toml", "second", ""), ("big.jar", "META-INF/mods.toml", "sodlum", "2"), ("big.jar", "fabric.mod.json", "plain", "1.0"), ("twin.jar", "fabric.mod.json", "plain", "1.0")]
    nodes = {(r.archive_id, r.node_path): (r.valid, r.message) for r in t.nodes.collect()}
    assert nodes["big.jar", "lib/inner.jar"][0] and not nodes["big.jar", "lib/broken.jar"][0]
    assert not any(nodes[n, ""][0] for n in ("bad.jar", "cut.jar", "empty.jar"))
    reports = documents(t.files, findings_of(t))
    rows = {r.archive_id: r for r in reports.collect()}
    assert rows["big.jar"].highest == "WARNING" and rows["big.jar"].findings[0].severity == "WARNING" and len(rows) == 5
    text = {r.archive_id: r.value for r in as_text(reports).collect()}
    assert text["big.jar"].startswith("FILE big.jar\nSHA-256 ")


def test_limits(spark):
    deep = jar({"leaf.txt": "x"})
    for k in range(4):
        deep = jar({f"d{k}.jar": deep})
    named = {"deep": deep, "many": jar({f"f{k}": "x" for k in range(30)}), "heavy": jar({f"C{k}.class": class_bytes(f"C{k}", strings=["x" * 40_000]) for k in range(6)}), "urls": jar({"U.class": class_bytes("p/U", strings=[f"https://pastebin.com/{k}" for k in range(10)])})}
    limits = Limits(max_entries=20, max_total_decompressed=100_000, max_findings_per_rule=3)
    t = decoded(files(spark, named), limits)
    nodes = {(r.archive_id, r.node_path): r.message for r in t.nodes.collect()}
    assert nodes["many", ""] == "too many entries" and "nested too deep" in nodes.values()
    status = sorted(r.status for r in t.classes.filter("archive_id = 'heavy'").collect())
    assert status.count("parsed") == 2 and status.count("skipped") >= 3
    urls = sorted((r.seq, r.title) for r in findings_of(t, limits=limits).filter("archive_id = 'urls' and rule_id = 'strings.url'").collect())
    assert len(urls) == 4 and urls[-1][1] == "7 more"


def test_malformed_classes():
    good = class_bytes("a/B", strings=["é"], refs=["[Ljava/net/Socket;", "[[I"], calls=[("[Lx/Y;", "clone")])
    of = archives.class_file(good)
    assert of["class_refs"] == ["a/B", "java/lang/Object", "java/net/Socket", "x/Y"] and of["member_refs"] == ["x/Y#clone"] and of["strings"] == ["é"]
    for bad in (b"", b"\xca\xfe\xba\xbe", good[:20], good[:-12], b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 61, 2) + b"\x63", b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 61, 1) + struct.pack(">HHH", 1, 5, 0)):
        with pytest.raises(ValueError):
            archives.class_file(bad)


def test_evidence_runs_without_python(spark):
    rows = spark.createDataFrame([("a", "", 0, "A.class", "parsed", "A", None, 61, [], [], ["x"])], archives.CLASS)
    plan = class_evidence(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_hash_list(spark, tmp_path):
    doc = {"schema_version": 1, "entries": {"A" * 64: {"classification": "verified", "name": "x"}, "b" * 64: {"classification": "odd"}, "short": {"classification": "VERIFIED"}, "c" * 64: 5, "d" * 64: {"classification": "SUSPICIOUS"}}}
    (tmp_path / "h.json").write_text("﻿" + json.dumps(doc), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{}")
    valid, rejected = read_hash_list(spark, str(tmp_path / "h.json"))
    assert sorted((r.sha256[0], r.classification, r.name) for r in valid.collect()) == [("a", "VERIFIED", "x"), ("d", "SUSPICIOUS", None)]
    assert rejected.count() == 3 and read_hash_list(spark, str(tmp_path / "bad.json"))[1].count() == 1
    new = spark.createDataFrame([("a" * 64, "SUSPICIOUS")], "sha256 string, classification string")
    both = removed(upserted(valid, new), "D" * 64)
    assert [(r.sha256[0], r.classification) for r in both.collect()] == [("a", "SUSPICIOUS")]
    assert json.loads(as_document(both).first().value)["entries"]["a" * 64]["classification"] == "SUSPICIOUS"
    data = jar({"x.txt": "y"})
    t = decoded(files(spark, {"x": data}))
    sha = t.files.first().sha256
    known = spark.createDataFrame([(sha, "SUSPICIOUS")], "sha256 string, classification string")
    assert ("hash.suspicious", "WARNING") in {(r.rule_id, r.severity) for r in findings_of(t, known).collect()}


def test_folder_reports_and_stream(spark, tmp_path):
    drop = tmp_path / "drop"
    (drop / "k=v").mkdir(parents=True)
    (drop / "a.jar").write_bytes(jar({"pkg/Main.class": class_bytes("pkg/Main", calls=NET + LOAD)}))
    (drop / "k=v" / "B.JAR").write_bytes(jar({"x.txt": "y"}))
    (drop / "c.zip").write_bytes(jar({"x.txt": "y"}))
    assert archives.scan(spark, str(drop), recursive=True).count() == 2
    t, f = triage(spark, str(drop))
    assert {r.file_name for r in t.files.collect()} == {"a.jar", "B.JAR"} and f.filter("rule_id = 'combo.downloader'").count() == 1
    reports = documents(t.files, f)
    write_report(reports, str(tmp_path / "out.json"), "json")
    assert spark.read.json(str(tmp_path / "out.json")).count() == 2
    with pytest.raises(ValueError):
        write_report(reports, str(tmp_path / "x"), "doc")
    q = watch(spark, str(drop), str(tmp_path / "stream"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).filter(F.col("rule_id") == "combo.downloader").count() == 1


def test_loaders_and_versions(spark):
    named = {
        "one": jar({"fabric.mod.json": FABRIC}), "two": jar({"quilt.mod.json": json.dumps({"quilt_loader": {"id": "q", "version": "2"}}), "fabric.mod.json": FABRIC}),
        "core": jar({"META-INF/MANIFEST.MF": "FMLCorePlugin: x.Y\n"}), "game": jar({"A.class": class_bytes("A", refs=["net/minecraft/X"])}), "java": jar({"A.class": class_bytes("A")}), "none": jar({"x.txt": "y"}),
        "built": jar({"META-INF/MANIFEST.MF": "Implementation-Version: 7.1\n", "META-INF/mods.toml": '[[mods]]\nmodId="m"\nversion="${file.jarVersion}"\n'}), "plug": jar({"plugin.yml": "name: 'P'\nversion: 3.0\nmain: a.B\nauthor: me\n"}),
    }
    t = decoded(files(spark, named))
    got = {r.archive_id: r.loader for r in loaders(t.nodes, t.mods, t.manifest, t.classes).collect()}
    assert got == {"one": "Fabric", "two": "Multi-loader (Fabric, Quilt)", "core": "Forge", "game": "unknown (game code)", "java": "unknown (Java classes)", "none": "unknown", "built": "Forge", "plug": "Bukkit"}
    versions = {(r.archive_id, r.mod_id): r.version for r in with_versions(t.mods, t.manifest).collect()}
    assert versions["built", "m"] == "7.1" and versions["plug", "P"] == "3.0" and versions["two", "q"] == "2"


def test_declared_dependencies(spark):
    toml = '[[mods]]\nmodId="a"\nversion="1"\ndescription=" Does things "\n[[dependencies.a]]\nmodId="{}"\nversionRange="[1,)"\nmandatory=true\n[[dependencies.a]]\nmodId="minecraft"\nmandatory=false\n[[dependencies.a]]\nmodId="jei"\ntype="optional"\nversionRange="[2,)"\n'
    texts = {
        "1": ("fabric.mod.json", '{"id": "f", "description": "d", "environment": "client", "mixins": ["a.json", {"config": "b.json"}], "depends": {"minecraft": "~1.20", "x": ["1", "2"], "fabricloader": 5}}'),
        "2": ("quilt.mod.json", '{"quilt_loader": {"id": "q", "group": "org.q", "metadata": {"description": "e"}, "depends": ["minecraft", {"id": "x", "versions": {"any": ["1", "2"]}}, {"id": "quilt_loader", "versions": ">=0.19"}]}}'),
        "3": ("META-INF/mods.toml", toml.format("neoforge")),
        "4": ("META-INF/mods.toml", toml.format("forge")),
        "5": ("mcmod.info", '[{"modid": "m", "mcversion": "1.7", "requiredMods": ["x"], "dependencies": ["y"]}]'),
        "6": ("plugin.yml", "name: P\nmain: a.B\ndepend: [Vault, 'X']\nsoftdepend:\n  - World-Edit\n  - Z\napi-version: 1.13\n"),
    }
    rows = [(i, "", "entry", name, 0, text.encode()) for i, (name, text) in texts.items()]
    read = spark.createDataFrame(rows, "archive_id string, node_path string, kind string, name string, entry_seq int, content binary")
    got = {r.archive_id: r for r in mods(read).collect()}
    deps = {i: sorted(tuple(d) for d in r.dependencies) for i, r in got.items()}
    assert deps["1"] == [("fabricloader", "*", False), ("minecraft", "~1.20", False), ("x", "1 || 2", False)]
    assert deps["2"] == [("minecraft", "*", False), ("quilt_loader", ">=0.19", False), ("x", "1 || 2", False)]
    assert deps["3"] == [("jei", "[2,)", True), ("minecraft", "*", True), ("neoforge", "[1,)", False)]
    assert deps["5"] == [("x", "*", False)]
    assert deps["6"] == [("Vault", "*", False), ("World-Edit", "*", True), ("X", "*", False), ("Z", "*", True)]
    assert [got[i].loader for i in "34"] == ["NeoForge", "Forge"]
    assert [got[i].description for i in "123"] == ["d", "e", "Does things"]
    assert (got["1"].environment, got["1"].mixins) == ("client", ["a.json", "b.json"])
    assert [got[i].minecraft_version for i in "1256"] == ["~1.20", "*", "1.7", "1.13"]
    assert [got[i].loader_version for i in "1234"] == ["*", ">=0.19", "[1,)", "[1,)"]
    assert [got[i].mod_group for i in "1236"] == [None, "org.q", None, None]
