"""Operator 12 against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sieveline.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, ids string, bucket string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    head = lambda c: own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
    return {c: head(c)[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}


def brute(rows):
    convs, members = rebuilt(rows), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[x] for x in children[p]]
        sums[p] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), *sums[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed=2):
    rng, rows = random.Random(seed), []
    for c in [*range(120), *range(-25, 0), 1000, 1001, 2**40]:
        for k in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b c", "", None, "x\ty\x0bz w", f"own {c}"])))
    rows += [(c, k, "user", f"turn {k} of all") for c in range(2000, 2150) for k in range(6)]  # a hot conversation
    rows += [(c, k, "user", f"turn {k} of all") for c in range(2200, 2260) for k in range(4)] + [(c, 4, "user", f"{c % 3}") for c in range(2200, 2260)]
    rows += [(c, 0, "system", "s" * 5) for c in range(3001, 3200)]  # turnless where the head is missing
    rows += [(5000, k, "user", f"deep {k % 2}") for k in range(900)] + [(5001, k, "user", f"deep {k % 2}") for k in range(900)]
    rows += [(None, 0, "user", "nobody"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (7, 3, "user", "tie"), (8, 0, "user", "w " * 50_000)]
    return rows


@pytest.mark.parametrize("local", [2, 40, 1000])
def test_prefix_trie(spark, local):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = P.prefix_trie(df, local)
    assert got.columns == [x.split()[0] for x in P.NODE.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(20, 0, "user", "one two", "", "")], SCHEMA)
    none = hashlib.sha256(b"").hexdigest()
    assert P.prefix_trie(df.limit(0)).count() == 0
    got = sorted(tuple(r) for r in P.prefix_trie(df).collect())
    assert got == sorted(brute([(20, 0, "user", "one two")])) and got[0][-1] in (none, hashlib.sha256(b"20").hexdigest())


def test_quicksort_emits_the_nodes_of_a_bucket():
    nodes = P.sorted_nodes([(5, [9, 1], [2, 3]), (3, [9, 1, 4], [2, 3, 1]), (8, [9, 7], [2, 5]), (1, [9], [2])], 0)
    assert [n[1:6] for n in nodes if n[0] < 0] == [[1, 1, 4, 2, [1]]]
    top = nodes[0]
    assert top[6:] == [2, 2, 3 * 2 + 1 * 3]


def test_ids_of_a_node_are_digested_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    ends = spark.createDataFrame([((0, 1), k) for k in range(5000)] + [((3, 2), -4)], "bucket struct<s:long,c:long>, conv_id long")
    want = {(0, 1): hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), (3, 2): hashlib.sha256(b"-4").hexdigest()}
    assert {tuple(r.bucket): r.ends_sha256 for r in P._digests(ends).collect()} == want
