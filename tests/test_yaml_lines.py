"""Plug-in descriptors: the forms of YAML that are read, and what is ignored."""

import pytest

from sieveline.sources.descriptors import mods, unreadable
from sieveline.sources.yaml_lines import sections

TEXT = """\ufeff# comment
name: CoolPlugin
version: '1.4'  # not a comment in quotes
main: com.cool.Plugin
api-version: "1.20"
authors: [Eve, "Frank", ,'x]
author: Me
depend:
  - Vault
  # a comment within
  - 'Quoted'
  more: no item
softdepend: [PlaceholderAPI]
description: |
  Line one
    Line two
not a key
  - lost
commands:
  cool:
    description: nested, ignored
  - odd
website: http://x.y/z:1 # comment
name2 : spaced
empty: []
version: 2
"""


def test_sections(spark):
    rows = spark.createDataFrame([(1, TEXT.replace("\ufeff", "")), (2, "a: 1\r\nb:\r- x\u2028- y\n"), (3, ""), (4, None), (5, "no colon\n  - x"), (6, "x: >-\n\n  folded\n\n  lines")], "id int, text string")
    got = {(r.id, r.key): (r.value, r["items"]) for r in sections(rows, ["id"]).collect()}
    assert {k[1] for k in got if k[0] == 1} == {"name", "version", "main", "api-version", "authors", "author", "depend", "softdepend", "description", "commands", "website", "name2", "empty"}
    assert got[1, "authors"] == (None, ["Eve", "Frank", "'x"]) and got[1, "depend"] == (None, ["Vault", "Quoted"]) and got[1, "description"] == ("Line one\nLine two", None)
    assert got[1, "commands"] == (None, ["odd"]) and got[1, "website"] == ("http://x.y/z:1", None) and got[1, "version"] == ("2", None) and got[1, "empty"] == (None, []) and got[1, "name2"] == ("spaced", None)
    assert got[2, "a"] == ("1", None) and got[2, "b"] == (None, ["x", "y"]) and got[6, "x"] == ("folded\nlines", None)
    assert not [k for k in got if k[0] in (3, 4, 5)]


def read(spark, named):
    return spark.createDataFrame([(f"a{k}", "", "entry", name, 0, text.encode()) for k, (name, text) in enumerate(named)], "archive_id string, node_path string, kind string, name string, entry_seq int, content binary")


def test_plugin(spark):
    [m] = mods(read(spark, [("plugin.yml", TEXT.replace("version: 2\n", ""))])).collect()
    assert (m.mod_id, m.mod_name, m.version, m.minecraft_version, m.entry_points, m.loader) == ("CoolPlugin", "CoolPlugin", "1.4", "1.20", ["com.cool.Plugin"], "Bukkit")
    assert m.authors == ["Eve", "Frank", "'x", "Me"] and m.description == "Line one\nLine two"
    assert [(d.id, d.range, d.optional) for d in m.dependencies] == [("Vault", "*", False), ("Quoted", "*", False), ("PlaceholderAPI", "*", True)]


@pytest.mark.parametrize("name, text", [
    ("fabric.mod.json", "{not json"), ("fabric.mod.json", "[1, 2, 3]"), ("fabric.mod.json", "[" * 100_000 + "]" * 100_000), ("quilt.mod.json", "{}"), ("META-INF/mods.toml", "this is = = not toml"),
    ("META-INF/mods.toml", 'modLoader="javafml"'), ("mcmod.info", '"just a string"'), ("plugin.yml", "nothing: useful"), ("paper-plugin.yml", "name:\n  - a list"),
], ids=range(9))
def test_descriptors_that_declare_nothing(spark, name, text):
    rows = read(spark, [(name, text)])
    assert mods(rows).count() == 0 and [r.name for r in unreadable(rows).collect()] == [name]


def test_lists_are_bounded_and_contributors_are_authors(spark):
    import json

    quilt = json.dumps({"quilt_loader": {"id": "q", "version": "1", "metadata": {"contributors": {"Ann": "Owner", "Bob": "Artist"}}}})
    fabric = json.dumps({"id": "f", "authors": [f"a{k}" for k in range(150)]})
    got = {r.mod_id: r.authors for r in mods(read(spark, [("quilt.mod.json", quilt), ("fabric.mod.json", fabric)])).collect()}
    assert sorted(got["q"]) == ["Ann", "Bob"] and got["f"] == [f"a{k}" for k in range(100)]
