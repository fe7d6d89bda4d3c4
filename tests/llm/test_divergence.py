"""Operator 13 against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sieveline.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, id string, term string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=30, ranks=50):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        docs[lang or ""].update(set(terms(text)))
        counts[lang or "", source or ""].update(terms(text))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    counts = {g: {t: n for t, n in c.items() if t in kept[g[0]]} for g, c in counts.items()}
    langs = defaultdict(Counter)
    for (lang, _), c in counts.items():
        langs[lang].update(c)

    def p(c, lang, t):
        return 1 + 10**9 * (c.get(t, 0) + 5) // (sum(c.values()) + 5 * len(kept[lang]))

    out = []
    for (lang, source), c in counts.items():
        pairs = [(-sum(abs(p(c, lang, t) - p(o, lang, t)) for t in kept[lang]), s.encode(), s) for (other, s), o in counts.items() if other == lang and s != source]
        found = [(p(langs[lang], lang, t) - p(c, lang, t), t.encode(), t) for t in c if p(c, lang, t) > p(langs[lang], lang, t)]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:ranks])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def rows_of(seed=4, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "é", "É", "ñandú", "x", "İ", "a1b", "don't", " ", "日本", "😀", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S", "", None, "é", "s\0"])
        rows.append((rng.choice([" ", "\n", "_", "-"]).join(rng.choice(words if lang == "en" else words[:9]) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [("only few words here", "fr", f"f{k}") for k in range(4)] + [(None, "fr", "f0"), (None, "en", "silent"), ("", "en", "mute")]
    rows += [("the " * 100_000, "en", "s1"), ("long" * 20_000 + " the", "en", "s2")] + [("z" * 100 + " hot hot", "en", "s1")] * 40
    return rows


@pytest.mark.parametrize("most, block, slice_", [(D.AUTOMATON, D.BLOCK, D.SLICE), (7, 2, 3), (0, 1, 1)])
def test_divergence(spark, most, block, slice_):
    rows = rows_of()
    df = spark.createDataFrame([(k, *r, "a", "b") for k, r in enumerate(rows)], SCHEMA).repartition(6)
    got = D.audited(df, most=most, block=block, slice_=slice_)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_terms_beyond_the_ranks_and_empty_tables(spark):
    rows = [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(j % 7, 120, 1 + j % 3)), "en", f"s{j % 4}") for j in range(200)]
    df = spark.createDataFrame([(k, *r, "", "") for k, r in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, D.audited(df).collect())) == brute(rows)
    assert D.audited(df.limit(0)).count() == 0


def test_counts_beyond_longs_in_the_product(spark):
    from pyspark.sql import functions as F

    big = spark.sql("SELECT 90000000000L AS n, 123456789012345L AS total, 1000L AS v").select(D._probability(F.col("n")).alias("p")).first().p
    assert big == 1 + 10**9 * 90_000_000_005 // (123_456_789_012_345 + 5000)
