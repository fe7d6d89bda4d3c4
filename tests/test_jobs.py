"""Watching and stopping a triage, decoding in SQL, the maintained list of known files, ids that arrive in different batches."""

import json
import os
import threading

import pytest

from sieveline import hashes as hash_tool
from sieveline.functions.sql import register
from sieveline.plans.job import Cancelled, Job
from sieveline.plans.triage import decoded, triage
from sieveline.sources import hash_list as H
from sieveline.sources.reports import as_text, documents
from sieveline.streaming.watch import watch
from tests.archives import class_bytes, jar
from tests.test_triage import FABRIC, LOAD, NET, files


@pytest.fixture
def folder(tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.jar").write_bytes(jar({"p/A.class": class_bytes("p/A", calls=NET + LOAD), "in.jar": jar({"x": "y"})}))
    (drop / "b.jar").write_bytes(b"no archive")
    return drop


def test_progress(spark, folder):
    told = []
    _, found = triage(spark, str(folder), job=Job(spark, told.append))
    steps = {s.name: s.counts for s in told}
    assert steps["read"] == {"rows": 6, "files": 2, "nodes": 3, "entries": 3, "refused": 1} and steps["classes"] == {"rows": 1, "parsed": 1}
    assert [s.name for s in told][:3] == ["read", "classes", "mods"] and steps["rules-classes"]["rows"] == found.filter("rule_id like 'combo.%' or rule_id = 'api.downloads'").count()
    assert all(s.seconds > 0 for s in told)


def test_cancelled_between_steps(spark, folder):
    job = Job(spark)
    job.cancel()
    with pytest.raises(Cancelled, match="before read"):
        triage(spark, str(folder), job=job)
    job = Job(spark, lambda step: step.name == "evidence" and job.cancel())
    t, found = triage(spark, str(folder), job=job)
    assert found.count() == 0 and t.rule_errors[0][0] == "cancelled"
    reports = documents(t.files, found, t)
    assert all("cancelled" in r.value for r in as_text(reports).collect())
    _, again = triage(spark, str(folder))
    assert set(found.columns) == set(again.columns) and found.unionByName(again).count() == again.count()


def test_cancelled_while_spark_runs(spark, tmp_path):
    job = Job(spark)
    slow = spark.range(0, 40, 1, 40).selectExpr("id", "reflect('java.lang.Thread', 'sleep', cast(1000 as bigint)) s")
    threading.Timer(1.5, job.cancel).start()
    with pytest.raises(Cancelled, match="in slow"):
        job.written(slow, str(tmp_path / "slow"), "slow")
    assert job.cancelled and not job.steps and spark.range(3).count() == 3


def test_sql_decodes_as_the_tables_do(spark):
    inner = jar({"i.txt": "inner"})
    named = {"a": jar({"META-INF/MANIFEST.MF": "A: b\n", "p/A.class": class_bytes("p/A"), "pic.png": b"MZ123456", "d/": b"", "in.jar": inner}), "b": b"none", "c": jar({"fabric.mod.json": FABRIC})}
    register(spark)
    rows = files(spark, named)
    rows.createOrReplaceTempView("jar_files")
    got = spark.sql("SELECT archive_id, e.* FROM jar_files, LATERAL jar_entries(content) e")
    want = decoded(rows).entries
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in got.columns) for r in df.collect())))
    assert key(got) == key(want) and got.count() == 7
    whole = spark.sql("SELECT archive_id, name, content FROM (SELECT archive_id, content AS data FROM jar_files), LATERAL jar_entries(data, true) WHERE content IS NOT NULL")
    assert {(r.archive_id, r.name) for r in whole.collect()} == {("a", "META-INF/MANIFEST.MF"), ("a", "p/A.class"), ("c", "fabric.mod.json")}
    for wrong in ("jar_entries(archive_id)", "jar_entries(content, size_bytes > 1)"):
        with pytest.raises(Exception, match="reads binary|constant"):
            spark.sql(f"SELECT * FROM jar_files, LATERAL {wrong}").collect()


@pytest.mark.parametrize("name", ["known.json", "known"])
def test_list_of_known_files(spark, tmp_path, capsys, name):
    at = str(tmp_path / name)
    data = jar({"fabric.mod.json": json.dumps({"id": "cool", "name": "Cool Mod", "version": "2.1"})})
    (tmp_path / "a.jar").write_bytes(data)
    (tmp_path / "plain.jar").write_bytes(jar({"META-INF/MANIFEST.MF": "Implementation-Version: 7\n"}))
    run = lambda *args: hash_tool.main([at, *args], spark)
    assert run("--list") == 0 and capsys.readouterr().out == "0 entries\n"
    assert run("--add", str(tmp_path / "a.jar"), str(tmp_path / "plain.jar"), "--classification", "verified", "--source", "own") == 0
    assert run("--sha256", " " + "A" * 64, "--classification", "SUSPICIOUS", "--name", "Bad") == 0
    rows = {r.name: (r.classification, r.version, r.source) for r in H.opened(spark, at)[0].collect()}
    assert rows == {"Cool Mod": ("VERIFIED", "2.1", "own"), "plain": ("VERIFIED", "7", "own"), "Bad": ("SUSPICIOUS", None, None)}
    capsys.readouterr()
    assert run("--list") == 0 and "Cool Mod 2.1" in capsys.readouterr().out
    assert run("--remove", "a" * 64) == 0 and run("--remove", "a" * 64) == 1
    assert {r.name for r in H.opened(spark, at)[0].collect()} == {"Cool Mod", "plain"}
    assert run("--sha256", "xyz", "--classification", "VERIFIED") == 1 and run("--add", str(tmp_path / "gone.jar"), "--classification", "VERIFIED") == 1
    if name == "known":
        assert H.versions(spark, at) == [1, 2, 3] and H.opened(spark, at, 2)[0].count() == 3
        assert sorted(p.name for p in (tmp_path / name).iterdir()) == ["v00000001", "v00000002", "v00000003"]
    else:
        assert json.loads((tmp_path / name).read_text())["schema_version"] == 1 and not list(tmp_path.glob("*.new"))
        (tmp_path / name).write_text("{broken")
        assert run("--list") == 1


def test_a_version_that_another_writer_took_is_refused(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a" * 64, "VERIFIED", None, None, None, None, None)], H.SCHEMA)
    at = str(tmp_path / "list")
    H.saved(rows, at)
    monkeypatch.setattr(H, "versions", lambda spark, path: [])
    with pytest.raises(FileExistsError):
        H.saved(rows, at)
    assert [p.name for p in (tmp_path / "list").iterdir()] == ["v00000001"]


def test_ids_of_files_that_arrive_later(spark, tmp_path):
    drop, out, cp = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "cp")
    drop.mkdir()
    mod = lambda i, more: jar({"fabric.mod.json": json.dumps({"id": i, "version": "1"}), more: "x"})
    told = lambda: {(r.batch, r.archive_id.partition("@")[0], r.location) for r in spark.read.parquet(out).filter("rule_id = 'batch.duplicate_mod_id'").collect()}

    def arrive(**named):
        for name, data in named.items():
            (drop / f"{name}.jar").write_bytes(data)
        watch(spark, str(drop), out, cp, once=True).awaitTermination()  # each time as after a restart

    arrive(a=mod("twin", "1"), b=mod("other", "2"))
    assert not told()
    arrive(c=mod("Twin", "3"))
    first = {(b, name) for b, name, _ in told()}
    assert {name for _, name in first} == {"a.jar", "c.jar"} and len({b for b, _ in first}) == 1
    arrive(d=mod("third", "4"), e=mod("OTHER", "5"))
    assert {name for b, name, _ in told() if (b, name) not in first} == {"b.jar", "e.jar"}


def test_callers_discard_what_was_staged(spark):
    t = decoded(files(spark, {"a": jar({"fabric.mod.json": FABRIC})}))
    assert t.mods.count() == 1 and os.path.isdir(t.folder)
    t.discard()
    assert not os.path.exists(t.folder)
    t.discard()
