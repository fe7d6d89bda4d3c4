"""Joins with tables of names, prefixes and fragments against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.operators import dimensions as D
from sieveline.operators import fragments as A
from sieveline.operators.lookup import lookalike


def normal(name):
    return re.sub("[^a-z0-9]", "", (name or "").lower())


def skeleton(n):
    return n.replace("rn", "m").replace("vv", "w").translate(str.maketrans("013547i", "olesatl"))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def imitated(name, known):
    n = normal(name)
    ks = {normal(k) for k in known if k is not None}
    if len(n) < 3 or n in ks:
        return None
    near = []
    for k in ks:
        if len(k) >= 5 and not n.startswith(k):
            d = edits(skeleton(n), skeleton(k))
            if d <= (1 if len(k) < 8 else 2):
                near.append((skeleton(n) != skeleton(k), d, k))
    return min(near, default=None)


def changed(rng, word):
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(word) + 1)
        word = rng.choice([word[:k] + rng.choice("abrnvl01") + word[k:], word[:k] + word[k + 1 :], word[: max(0, k - 1)] + rng.choice("abrnvl01") + word[k:]])
    return word


@pytest.mark.parametrize("broadcast", [D.BROADCAST_ROWS, 0])
def test_lookalikes_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abrnvl01") for _ in range(n))
    known = [word(rng.choice([2, 4, 5, 6, 7, 8, 9, 12, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 40])) for _ in range(150)] + ["rnrnrnrn", "Same Name!", "samename", None, ""]
    names = [changed(rng, rng.choice([k for k in known if k])) for _ in range(700)] + ["mmmm", "mmm", "", None, "Sarne-Name", "samename and more", known[0], "x" * 5000]
    rows = spark.createDataFrame([(i, n, "old") for i, n in enumerate(names)], "id long, name string, like string")
    got = {r.id: r.like for r in D.lookalikes(rows, "name", spark.createDataFrame([(k,) for k in known], "label string"), "label").collect()}
    assert len(got) == len(names)
    for i, n in enumerate(names):
        want, like = imitated(n, known), got[i]
        assert (like and (like.kind == "distance", like.distance, like.known)) == want, (n, like, want)
    assert sum(v is not None for v in got.values()) > 300


def test_lookalikes_equal_the_column_function(spark):
    names = ["sod1um", "Iithium", "optifinee", "sodium", "sodlum", "jel", "journeymop", "zz", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    known = spark.createDataFrame([(k,) for k in R.POPULAR_NAMES], "known string")
    one = {r.name: r.like for r in rows.withColumn("like", lookalike(F.col("name"), R.POPULAR_NAMES)).collect()}
    assert {r.name: r.like for r in D.lookalikes(rows, "name", known, "known").collect()} == one


def test_few_candidates_are_measured(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    known = [word() for _ in range(3000)]
    names = spark.createDataFrame([(changed(rng, k),) for k in known], "n string").distinct()
    met = D.candidates(names, D.known_names(spark.createDataFrame([(k,) for k in known], "known string"), "known")).select("n", "known").distinct().count()
    assert met < 2 * len(known)  # of 9,000,000 pairs


def test_tables_of_short_names_and_none(spark):
    rows = spark.createDataFrame([("sod1um",), ("spdium",), ("sodi",), ("x" * 40,)], "name string")
    known = spark.createDataFrame([("sodium",), ("abcde",)], "k string")
    assert {r.name: r.like and r.like.known for r in D.lookalikes(rows, "name", known, "k").collect()} == {"sod1um": "sodium", "spdium": "sodium", "sodi": None, "x" * 40: None}
    assert D.lookalikes(rows, "name", known.limit(0), "k").filter("like is null").count() == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_normalised_when_they_are_distinct(spark):
    texts = spark.range(300).select(F.concat_ws(" ", F.lit("sod1um sodium Spdium other"), F.concat(F.lit("w"), F.col("id") % 7)).alias("t"))
    rows = texts.select(F.explode(F.split("t", " ")).alias("_name")).distinct()
    found = D.lookalikes(rows, "_name", spark.createDataFrame([("sodium",), ("abcdefgh",)], "k string"), "k").filter("like is not null")
    assert {r["_name"]: r.like.known for r in found.collect()} == {"sod1um": "sodium", "Spdium": "sodium"}
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    split = [i for i, line in enumerate(lines) if "explode(split(" in line]
    for i in split:
        k = max(k for k in range(i) if "Aggregate [" in lines[k])
        assert not any("regexp_replace" in line for line in lines[k:i]), "\n".join(lines[k : i + 1])
    ran = plan_of(found).split("Initial Plan")[0]
    assert split and ran.count("explode(split(") == 1, ran  # the texts are read once


def test_rows_of_repeated_names_keep_their_number(spark):
    names = ["sod1um", "Sod1um", "SOD1UM!", "sod1um", None, None, "", "!!", "sodium", "other"]
    rows = spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "_n long, name string, _name string")
    got = {r["_n"]: (r.name, r["_name"], r.like and r.like.known) for r in D.lookalikes(rows, "name", spark.createDataFrame([("sodium",)], "k string"), "k").collect()}
    assert got == {i: (n, n, "sodium" if n and "1" in n else None) for i, n in enumerate(names)}


@pytest.mark.parametrize("broadcast", [D.BROADCAST_ROWS, 0])
def test_prefix_tables(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("ab/é") for _ in range(rng.randint(a, b)))
    prefixes = [(word(1, 5), f"p{k}", rng.randint(0, 9)) for k in range(80)] + [("", "any", 8), (None, "no", 0)]
    exact = [(word(2, 6), f"e{k}") for k in range(60)]
    names = [word(0, 8) for _ in range(400)] + [None, "", "zz"]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "_n string, value long")
    got = D.with_prefix_of(rows, "_n", spark.createDataFrame(exact, "name string, value string"), spark.createDataFrame(prefixes, "prefix string, value string, at int"), "at")

    def value(n):
        if n is None:
            return None
        return min((v for e, v in exact if e == n), default=None) or min(((at, p, v) for p, v, at in prefixes if p is not None and n.startswith(p)), default=(0, "", None))[2]

    assert sorted(((r._n, r.value) for r in got.collect()), key=repr) == sorted(((n, value(n)) for n in names), key=repr)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def alternation(texts, fragments):
    pattern = re.compile("|".join(map(re.escape, fragments)))
    return [[(m.start(), m.group()) for m in pattern.finditer(t or "")] for t in texts]


@pytest.mark.parametrize("slice_bytes", [A.SLICE_BYTES, 5])
def test_fragments_equal_an_alternation(spark, slice_bytes):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abc.é😀") for _ in range(rng.randint(a, b)))
    fragments = list(dict.fromkeys([word(1, 4) for _ in range(40)]))
    texts = [word(0, 60) for _ in range(200)] + [None, "", "a" * 100_000]
    table = spark.createDataFrame([*[(f, k) for k, f in enumerate(fragments)], (fragments[0], 99), ("", -1), (None, -1)], "f string, k int").repartition(5)
    listed = A.fragment_list(table, "f", ["k"], slice_bytes)
    assert (len(listed.slices) > 1) == (slice_bytes == 5)
    names = {r.place: r.fragment for r in listed.table.collect()}
    assert [names[k] for k in range(len(fragments))] == fragments
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "found long, t string, place string").repartition(3)
    got = {r.found: [(h.start, names[h.place]) for h in r.hits] for r in A.fragments_in(rows, "t", listed, "hits").collect()}
    assert [got[i] for i in range(len(texts))] == alternation(texts, fragments)
    again = A.fragment_list(table, "f", ["k"], 1 << 20)
    assert again.version == listed.version != A.fragment_list(table.filter("k > 0"), "f", ["k"]).version


def test_many_fragments(spark):
    fragments = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(".")).alias("f"), "id")
    listed = A.fragment_list(fragments, "f", ["id"])
    rows = spark.range(300).select("id", F.concat(F.lit("see w"), (F.col("id") * 331).cast("string"), F.lit(". and w")).alias("t"))
    got = {r.id: [h.place for h in r.found] for r in A.fragments_in(rows, "t", listed).collect()}
    assert got == {k: [k * 331] for k in range(300)}


def test_no_fragments_and_tables_too_large(spark, monkeypatch):
    none = A.fragment_list(spark.createDataFrame([], "f string, k int"), "f", ["k"])
    rows = spark.createDataFrame([("text",)], "t string")
    assert A.fragments_in(rows, "t", none).first().found == []
    monkeypatch.setattr(A, "MOST_ROWS", 2)
    with pytest.raises(ValueError, match="in parts"):
        A.fragment_list(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "f string, k int"), "f", ["k"])
