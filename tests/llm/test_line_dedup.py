"""Operator 11 against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from sieveline.llm import line_dedup as L


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def rows_of(seed=3, n=160):
    rng = random.Random(seed)
    common = [f"the line number {k} that many texts have" for k in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice([rng.choice(common), f" \t{rng.choice(common).upper()}\r", f"own line of text {i} and {rng.randint(0, 3)} more", "short", ""]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(i, f"a line {k} of texts far from each other") for k in range(20) for i in (-100 - k, 400 + k, 1600 + k, 5000 + k)[k % 2 :]]
    wide = "É" * 20
    rows += [(1000 + k, f"a hot line that everyone has\n{wide}\nx{k}") for k in range(300)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "twenty code points!\n" * 5), (2004, "20 code points are !"), (2005, "20 code points are !\n20 CODE POINTS ARE !"), (2006, "20 code points are !\nnext")]
    rows += [(2010, "only in rows without id, but thrice"), (2011, wide), (2011, wide), (2012, " a key with an em space stays so"), (2013, "a key with an em space stays so")]
    rows += [(None, f"nobody knows who wrote this line {k // 3}\nthe line number 1 that many texts have") for k in range(7)]
    rows += [(3000, "\n".join(f"line {k % 7000} of a very long text" for k in range(20_000))), (3001, "\n".join(f"line {k} of a very long text" for k in range(9000))), (3002, "line 5 of a very long text\nline 8999 of a very long text")]
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, kept string, t1 string").repartition(7)
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)), key=repr)
    got = L.line_digests(df, batches, fanout)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    texts = L.deduplicated(df, batches, fanout)
    assert texts.columns == df.columns and texts.filter("kept = 'a' AND t1 = 'b'").count() == len(rows)
    assert sorted((r.doc_id, r.text) for r in texts.collect() if r.doc_id is not None) == sorted((i, t) for i, _, _, t in brute(rows) if i is not None)
    assert L.line_digests(df.limit(0), batches, fanout).count() == 0


def test_runs_are_levelled_and_settled_keys_are_not_added_again(spark):
    runs = L.Runs(spark, fanout=2)
    batch = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, n long, keep long")
    runs.add(batch([(1, 1, 5, 90), (2, 2, 1, 80), (4, 4, 3, None)]))
    runs.add(batch([(1, 1, 2, 70), (2, 2, 1, 99), (3, 3, 1, 5), (4, 4, 1, None)]))
    assert [len(x) for x in runs.levels] == [0, 1]
    state = lambda: sorted(tuple(r) for r in runs.merged().collect())
    assert state() == [(1, 1, 5, 90), (2, 2, 2, 99), (3, 3, 1, 5), (4, 4, 3, None)]
    runs.add(batch([(1, 1, 1, 95), (2, 2, 1, 1), (4, 4, 1, 7)]))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert state() == [(1, 1, 6, 95), (2, 2, 3, 99), (3, 3, 1, 5), (4, 4, 4, 7)]
    runs.add(batch([(9, 9, 1, 1)]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    runs.release()


def test_runs_are_joined_without_moving_their_rows(spark):
    runs = L.Runs(spark, fanout=3)
    batch = spark.createDataFrame([(k, k, 1, k) for k in range(50)], "h1 long, h2 long, n long, keep long")
    runs.add(batch)
    a = runs.all()[0]
    plan = batch.join(a.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    runs.add(batch)
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
    assert sorted(tuple(r) for r in runs.merged().collect()) == [(k, k, 2, k) for k in range(50)]
    runs.release()
