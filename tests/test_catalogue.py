"""Every catalogue query against its SQL in DuckDB, and column functions on golden rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.functions import text as T
from sieveline.functions import urls as U
from sieveline.operators.lookup import lookalike
from sieveline.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows, at: sorted(repr([r[k] for k in at]) for r in rows)
    at = sorted(got.columns)
    rows = [r.asDict() for r in got.collect()]
    assert key(rows, at) == key([dict(zip(want.columns, r)) for r in want.fetchall()], at)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("url, severity, confidence", [
    ("https://discord.com/api/webhooks/123/abc-D_e", "WARNING", "HIGH"), ("https://canary.discordapp.com/api/v9/webhooks/1/x", "WARNING", "HIGH"), ("https://discord.com/api/webhooks/", "REVIEW", "MEDIUM"), ("https://discord.com/api/v10/webhooks/12", "REVIEW", "MEDIUM"),
    ("https://api.telegram.org/bot123:x/send", "WARNING", "HIGH"), ("http://127.0.0.1:8080/x", "INFO", "HIGH"), ("http://192.168.1.4", "INFO", "HIGH"), ("http://8.8.8.8/a", "REVIEW", "MEDIUM"), ("http://[::1]/a", "INFO", "HIGH"), ("http://[2001:db9::1]/a", "REVIEW", "MEDIUM"),
    ("https://cdn.discordapp.com/attachments/1/2/a.jar", "REVIEW", "MEDIUM"), ("https://pastebin.com/raw/x", "REVIEW", "MEDIUM"), ("https://notpastebin.com/raw/x", "INFO", "MEDIUM"), ("https://a.b.ngrok.io", "REVIEW", "MEDIUM"), ("https://gofile.io/d/x", "REVIEW", "MEDIUM"),
    ("https://api.ipify.org", "REVIEW", "MEDIUM"), ("https://bit.ly/x", "REVIEW", "LOW"), ("http://free.tk/x", "REVIEW", "LOW"), ("https://raw.githubusercontent.com/x", "INFO", "HIGH"), ("https://user@GitHub.com./x", "INFO", "HIGH"), ("https://example.org", "INFO", "MEDIUM"), ("http://01.2.3.4/", "INFO", "MEDIUM"),
])
def test_urls(spark, url, severity, confidence):
    v = one(spark, U.classify_url(F.lit(url)))
    assert (v.severity, v.confidence) == (severity, confidence)


@pytest.mark.parametrize("text, bits", [("", 0.0), ("aaaa", 0.0), ("abcd", 2.0), ("aabb", 1.0)])
def test_entropy(spark, text, bits):
    assert one(spark, T.shannon_entropy(F.lit(text))) == pytest.approx(bits)


@pytest.mark.parametrize("name, ext", [("a.TXT", ".txt"), ("x/.gitignore", ""), ("a.", "."), ("...", ""), (".a.b", ".b"), ("d.e/f", ""), ("a.tar.gz", ".gz")])
def test_extensions(spark, name, ext):
    assert one(spark, T.extension_of(F.lit(name))) == ext


@pytest.mark.parametrize("name, unsafe", [("/a", True), ("a\\b", True), ("C:x", True), ("a/../b", True), ("a..b/c", False), ("..", True), ("a/b", False)])
def test_unsafe_paths(spark, name, unsafe):
    assert one(spark, T.is_unsafe_path(F.lit(name))) is unsafe


@pytest.mark.parametrize("text, shown", [(None, ""), ("a\tb", "a b"), ("a\x1b[31m", "a�[31m"), ("x‮y", "x�y"), ("a\nb", "a�b"), ("x" * 12, "x" * 10 + "…[truncated]")])
def test_safe_text(spark, text, shown):
    assert one(spark, T.safe_text(F.lit(text).cast("string"), 10)) == shown


@pytest.mark.parametrize("name, known", [("sod1um", "sodium"), ("Iithium", "lithium"), ("optifinee", None), ("sodium", None), ("sodlum", "sodium"), ("jel", None), ("journeymop", "journeymap"), ("zz", None)])
def test_lookalikes(spark, name, known):
    got = one(spark, lookalike(F.lit(name), R.POPULAR_NAMES))
    assert (got and got.known) == known


@pytest.mark.parametrize("text, data", [("QUJD", b"ABC"), ("QUI", b"AB"), ("-_-_", b"\xfb\xff\xbf"), ("A", None), ("QU*D", None), ("", b"")])
def test_base64(spark, text, data):
    got = one(spark, T.try_base64(F.lit(text)))
    assert (None if got is None else bytes(got)) == data


@pytest.mark.parametrize("ip, private", [("10.0.0.1", True), ("100.64.0.1", False), ("198.18.0.1", True), ("203.0.113.5", True), ("224.0.0.1", False), ("192.0.0.9", False), ("8.8.8.8", False), ("08.8.8.8", None), ("256.1.1.1", None)])
def test_private_addresses(spark, ip, private):
    assert one(spark, U.is_private_ipv4(U.ipv4_number(F.lit(ip)))) is private


def test_urls_in_text(spark):
    got = one(spark, U.urls_in(F.lit("see (https://a.b/c). and wss://x.y/z, not ftp:/q")))
    assert got == ["https://a.b/c", "wss://x.y/z"]


def test_without_the_training_data_operators(tmp_path):
    """The entry module imports, and its other queries are there, where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "sieveline", tmp_path / "sieveline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    n, ops = said.stdout.split()
    assert int(n) == len(QUERIES) and int(ops) == sum(k.startswith("op") for k in QUERIES)
