"""Grades that hang on details: first words, decoded addresses, native splits, look-alikes, descriptions of modules."""

import base64
import json

from pyspark.sql import functions as F

from sieveline.operators.capping import capped, where_of
from sieveline.operators.lookup import lookalike
from sieveline.operators.reports import most_common, repeated_names, shared_ids
from sieveline.plans.evidence import class_evidence, literal_facts
from sieveline.plans.explanations import EXPLANATIONS, RATIONALES
from sieveline.plans.triage import decoded, findings_of
from sieveline.refdata import POPULAR_NAMES
from tests.archives import class_bytes, jar
from tests.test_triage import EXEC, NET, files, found

SYSTEM_LOAD, BOUND = [("java/lang/System", "load")], ["com/sun/jna/Pointer"]
HIDDEN = base64.b64encode(b"post to https://discord.com/api/webhooks/12/abc-def please, all of it").decode()


def test_lookalikes_by_skeleton(spark):
    names = ["1ithiurnn", "0ptlf1n", "opt1f1nee", "w0rlded1tt", "sodiurn", "sodium", "sodium-extras", "ab", "nothing alike at all"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("like", lookalike(F.col("name"), POPULAR_NAMES))
    got = {r.name: r.like and r.like.known for r in rows.collect()}
    assert got == {"1ithiurnn": "lithium", "0ptlf1n": "optifine", "opt1f1nee": "optifine", "w0rlded1tt": "worldedit", "sodiurn": "sodium", "sodium": None, "sodium-extras": None, "ab": None, "nothing alike at all": None}


def test_grades(spark):
    one = lambda **args: {"p/A.class": class_bytes("p/A", **args)}
    many = {f"p/C{k}.class": class_bytes(f"p/C{k}", refs=["java/net/Socket"]) for k in range(8)}
    mod = lambda **fields: {"fabric.mod.json": json.dumps({"version": "1", **fields})}
    named = {
        "curl": one(calls=EXEC, strings=["curl http://x/y", "xdg-open"]), "open": one(calls=EXEC, strings=["xdg-open file"]), "exe": one(calls=EXEC, strings=["C:/Tools/Thing.exe -q"]), "none": one(calls=EXEC),
        "theft": one(strings=["Local Storage/leveldb", HIDDEN]), "token": one(calls=NET + [("net/minecraft/Session", "getAccessToken")], strings=[HIDDEN]),
        "native": one(calls=SYSTEM_LOAD, refs=BOUND), "bound": one(refs=[*BOUND, "java/net/Socket"]), "own": {**one(calls=SYSTEM_LOAD), "lib/x.dll": "MZ"}, "fetched": {**one(calls=SYSTEM_LOAD + NET), "lib/x.dll": "MZ"},
        "module": {"module-info.class": class_bytes("module-info"), **one()}, "plain": {"Main.class": class_bytes("Main")}, "many": many,
        "inside": one(strings=[base64.b64encode(b"connect 8.8.8.8:4444 and then stay there for long enough").decode()]), "name": mod(id="fine", name="S0dium"), "both": mod(id="sodlum", name="Sodium"),
    }
    got = {jar_: {r.rule_id: r for r in rows} for jar_, rows in found(findings_of(decoded(files(spark, {k: jar(v) for k, v in named.items()})))).items()}
    runs = {k: got[k]["api.process_execution"] for k in ("curl", "open", "exe", "none")}
    assert {k: r.confidence for k, r in runs.items()} == {"curl": "MEDIUM", "open": "LOW", "exe": "MEDIUM", "none": "MEDIUM"}
    assert runs["curl"].title == "Starts other programs (xdg-open, curl)" and runs["none"].title == "Starts other programs (command not visible)"
    assert runs["exe"].context.startswith("other programs: thing.exe") and runs["curl"].context.startswith("helpers: xdg-open; often abused: curl")
    assert got["theft"]["combo.data_theft"].severity == "WARNING"
    assert (got["token"]["combo.session_token_network"].severity, got["token"]["combo.session_token_network"].confidence) == ("WARNING", "HIGH")
    assert {k: got[k]["api.native_loading"].confidence for k in ("native", "bound", "own", "fetched")} == {"native": "MEDIUM", "bound": "LOW", "own": "LOW", "fetched": "MEDIUM"}
    assert "classes.default_package" not in got["module"] and "classes.default_package" in got["plain"]
    assert got["many"]["api.network"].location == "p/C0.class, p/C1.class, p/C2.class, p/C3.class, p/C4.class (+3 more)"
    assert "strings.ip_port" in got["inside"]
    assert got["name"]["metadata.lookalike"].location == "fabric.mod.json name: S0dium" and "metadata.popular_mod_claim" not in got["name"]
    assert {"metadata.lookalike", "metadata.popular_mod_claim"} <= set(got["both"])


def test_lists_and_reasons(spark):
    encoded = base64.b64encode(bytes(range(60, 160))).decode()
    named = {
        "a": jar({"p/A.class": class_bytes("p/A", strings=["8.8.8.8:11", "10.0.0.1:22", "java.lang.Runtime", "Kill-Aura", "Local Storage/leveldb", encoded, *(f"https://github.com/{k:02}" for k in range(12))]), "p/B.class": class_bytes("p/B", strings=["8.8.8.8:11", "9.9.9.9:33"]), "fabric.mod.json": json.dumps({"id": "twin", "version": "1"})}),
        "b": jar({"fabric.mod.json": json.dumps({"id": "Twin", "version": "1"}), "p/L.class": class_bytes("p/L", super_name="java/net/URLClassLoader")}),
    }
    rows = found(findings_of(decoded(files(spark, named))))
    a, b = ({r.rule_id: r for r in rows[k]} for k in "ab")
    assert a["strings.ip_port"].location == "8.8.8.8:11 in p/A.class, 9.9.9.9:33 in p/B.class"
    assert a["api.reflective_sensitive"].location == "java.lang.Runtime in p/A.class" and a["classes.cheat_feature_strings"].location == "Kill-Aura in p/A.class"
    assert a["strings.sensitive"].location.endswith("' in p/A.class") and a["strings.encoded"].location.startswith(f"p/A.class: {encoded[:60]}… (entropy ")
    assert a["strings.urls_other"].location == ", ".join(f"https://github.com/{k:02}" for k in range(10)) + " (+2 more)"
    assert a["batch.duplicate_mod_id"].location == "also in b" and b["batch.duplicate_mod_id"].location == "also in a"
    assert b["api.dynamic_loading"].context == "1 from what the archive itself has"
    assert all(r.explanation == EXPLANATIONS[r.rule_id] and r.rationale in RATIONALES.values() for rs in rows.values() for r in rs)


def test_one_finding_an_archive_with_the_places_of_all_classes(spark):
    """Rules 15 and 18 speak of the archive: one row, whatever the number of classes, and confidence over all of them."""
    token, payload = [("net/minecraft/Session", "getAccessToken")], base64.b64encode(b"MZ" + bytes(60)).decode()
    b64 = lambda text: base64.b64encode(text.encode()).decode()
    hidden = b64("go on to https://pastebin.com/raw/abc now and wait there")
    three = {f"p/C{k}.class": class_bytes(f"p/C{k}", calls=NET + token if k else token, strings=[payload, hidden, "https://example.org/x"]) for k in range(7)}
    three["q/D.class"] = class_bytes("q/D", calls=[("java/util/Base64", "getDecoder")], strings=[payload])
    plain = {"p/T.class": class_bytes("p/T", calls=NET + token), "p/U.class": class_bytes("p/U", strings=["https://pastebin.com/x"]), "p/H.class": class_bytes("p/H", strings=[b64("only https://example.org/page and nothing else in here")])}
    rows = found(findings_of(decoded(files(spark, {"a": jar(three), "b": jar(plain), "c": jar({"p/T.class": class_bytes("p/T", calls=NET + token)})}))))
    for rule in ("combo.session_token_network", "strings.encoded_executable", "strings.encoded_url"):
        assert [r.rule_id for r in rows["a"]].count(rule) == 1
    a, b, c = ({r.rule_id: r for r in rows[k]} for k in "abc")
    at = lambda r: (r.severity, r.confidence, r.location)
    assert at(a["combo.session_token_network"]) == ("WARNING", "MEDIUM", "p/C1.class, p/C2.class, p/C3.class, p/C4.class, p/C5.class (+1 more)")
    assert a["combo.session_token_network"].context == "suspicious addresses elsewhere: https://pastebin.com/raw/abc"  # first seen in C0, which does not reach the network
    exe = "Windows executable (PE) in p/C{}.class"
    assert at(a["strings.encoded_executable"]) == ("WARNING", "HIGH", ", ".join(exe.format(k) for k in range(5)) + " (+3 more)")
    assert at(a["strings.encoded_url"]) == ("REVIEW", "MEDIUM", ", ".join(f"p/C{k}.class: https://pastebin.com/raw/abc" for k in range(5)) + " (+2 more)")
    assert a["strings.encoded_url"].title == "Addresses inside encoded literals: 7"
    assert a["strings.url"].location == "https://pastebin.com/raw/abc in p/C0.class (Base64-decoded string)"
    assert at(b["combo.session_token_network"])[:2] == ("WARNING", "MEDIUM") and at(c["combo.session_token_network"])[:2] == ("REVIEW", "MEDIUM")
    assert at(b["strings.encoded_url"]) == ("REVIEW", "LOW", "p/H.class: https://example.org/page")


def test_facts_say_where_a_literal_came_from(spark):
    b64 = lambda text: base64.b64encode(text.encode()).decode()
    inner = b64("Local Storage/leveldb at https://pastebin.com/raw/x with 8.8.8.8:99 in it")
    data = jar({"p/A.class": class_bytes("p/A", strings=["wallet.dat", inner, "wallet.dat", "https://pastebin.com/raw/x", "A" * 40 + "\n"]), "p/B.class": class_bytes("p/B", strings=["WALLET.DAT"])})
    t = decoded(files(spark, {"a": data}))
    facts = [tuple(r) for r in literal_facts(class_evidence(t.classes)).orderBy("entry_seq", "place").select("entry_name", "literal", "kind", "item", "decoded").collect()]
    assert facts[:5] == [("p/A.class", 0, "fragment", "wallet.dat", False), ("p/A.class", 1, "encoded", facts[1][3], False), ("p/A.class", 1, "url", "https://pastebin.com/raw/x", True), ("p/A.class", 1, "ip", "8.8.8.8:99", True), ("p/A.class", 1, "fragment", facts[4][3], True)]
    assert facts[5:] == [("p/A.class", 2, "fragment", "wallet.dat", False), ("p/A.class", 3, "url", "https://pastebin.com/raw/x", False), ("p/B.class", 0, "fragment", "wallet.dat", False)]
    told = {(r.rule_id, r.title): r.location for r in found(findings_of(t))["a"]}
    assert [v for (rule, _), v in told.items() if rule == "strings.ip_port"] == ["8.8.8.8:99 in p/A.class (Base64-decoded string)"]
    places = ", ".join(v for (rule, _), v in told.items() if rule == "strings.sensitive")
    assert "'wallet.dat' in p/A.class, 'wallet.dat' in p/B.class" in places and "' in p/A.class (Base64-decoded string)" in places


def test_groups_are_cut_before_they_are_shuffled(spark):
    """No window over a whole group: rows are limited in each task, and counts come from aggregates."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).selectExpr("id % 3 g", "id", "cast(id % 2 as int) severity_rank", "cast(id % 3 as int) confidence_rank", "cast(id as string) item")
    for df in (capped(rows, ["g"], ["id"], 5), where_of(rows, ["g"], ["id"], "item"), shared_ids(rows.selectExpr("id owner", "cast(g as string) ident"), "owner", "ident")):
        steps = [x.strip(" +-:*()0123456789").split(" ")[0] for x in plan(df).splitlines()]
        windows = [k for k, x in enumerate(steps) if x == "Window"]
        assert windows
        for k in windows:  # limited behind the exchange and before it
            below = [x for x in steps[k + 1 :] if x in ("WindowGroupLimit", "Exchange")]
            assert below[:3] == ["WindowGroupLimit", "Exchange", "WindowGroupLimit"]


def test_hot_groups(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) g", "id", "cast(id % 3 as int) severity_rank", "if(id = 3, null, cast(id % 2 as int)) confidence_rank")
    rest = capped(rows, ["g"], ["id"], 4).filter("is_rest").collect()
    assert [(r.g, r.id, r.rn, r.n_rest, r.severity_rank, r.confidence_rank) for r in rest] == [("hot", None, 5, n // 3 - 4, 0, 1)]
    hot = where_of(rows, ["g"], ["id"], "id", 3).filter("g = 'hot'").first()
    assert (hot.n, hot.where) == (n // 3, f"0, 3, 6 (+{n // 3 - 3} more)")
    shared = shared_ids(rows, "id", "g")
    assert shared.count() == n // 3 and {(r.n_owners, r.others) for r in shared.filter("owner > 15").collect()} == {(n // 3, "0, 3, 6, 9, 12")}


def test_places_of_any_group(spark):
    """Numbers within a group that spans several ranges, null groups and gaps as plain sorting gives them."""
    data = [(None if k % 5 == 0 else "x" if k % 3 else "y", k * 700_000 - 5_000_000) for k in range(40)]
    rows = spark.createDataFrame(data, "name string, seq long")
    want = {}
    for name, seq in sorted(data, key=lambda r: r[1]):
        want.setdefault(name, []).append(seq)
    got = {(name, seq): copy for name, seq, copy in repeated_names(rows, [], "name", "seq").select("name", "seq", "copy").collect()}
    assert got == {(name, seq): k for name, seqs in want.items() for k, seq in enumerate(seqs, 1) if k > 1}
    places = [(r[0], r[1], r[2], r[3]) for r in most_common(rows, [], "name", "seq").select("place", "name", "n", "first_seq").orderBy("place").collect()]
    best = sorted(((len(s), s[0], n) for n, s in want.items()), key=lambda r: (-r[0], r[1]))
    assert places == [(k, n, c, first) for k, (c, first, n) in enumerate(best, 1)]


def test_errors(spark):
    named = {
        "a": jar({"p/A.class": b"\xca\xfe\xba\xbe\x00", "fabric.mod.json": "{broken", "META-INF/mods.toml": "= no", "quilt.mod.json": json.dumps({"quilt_loader": {"id": "q"}}), "lib/x.jar": b"PK\x03\x04 no"}),
        "b": b"no archive", "c": jar({"p/C.class": class_bytes("p/C"), "fabric.mod.json": json.dumps({"id": "c"})}),
    }
    t = decoded(files(spark, named))
    got = {(r.archive_id, r.node_path, r.stage, r.entry) for r in t.errors.collect() if r.stage != "contents"}
    assert got == {("a", "", "classes", "p/A.class"), ("a", "", "metadata", "fabric.mod.json"), ("a", "", "metadata", "META-INF/mods.toml"), ("a", "lib/x.jar", "open", ""), ("b", "", "open", "")}
    assert [r.mod_id for r in t.mods.filter("archive_id = 'a'").collect()] == ["q"] and all(r.message for r in t.errors.collect())
