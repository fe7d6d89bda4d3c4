import random
import re

import pytest

from sieveline.llm.ngram_join import near_groups, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: (sizes, component)} over (doc_id, text) with one text an id."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=5, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(12)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts[-40:] + texts[:3]).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w = w[: len(w) * 9 // 10 + 1]
        else:
            w = [word() for _ in range(rng.choice([1, 3, 5, 8, 60, 90, 200]))]
        if kind > 0.9:
            w = w + common
        texts.append(" ".join(w))
        rows.append((i * 3 + 1, rng.choice([str, str.upper])(texts[-1])))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) * 0.9
    kept = {r.doc_id for r in one_of_each(df).collect()}
    assert kept == {c for _, c in want.values()}


@pytest.mark.parametrize("size", [90, 150])
def test_a_hot_group_of_near_copies(spark, size):
    rng = random.Random(size)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df).collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "a b"), (8, "a b"), (9, "É e"), (10, "é e"), (11, "same words here"), (11, "same words here")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in near_groups(df).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 9), (10, 1, 10), (11, 1, 11), (11, 1, 11)]
    assert near_groups(df.limit(0)).count() == 0
    assert one_of_each(df).columns == df.columns


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 70000}" for k in range(300_000))
    df = spark.createDataFrame([(1, long, None, None), (2, long + " tail", None, None), (3, "other words stand here alone", None, None)], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}
