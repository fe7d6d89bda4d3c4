"""Hashes and memories of byte stretches: equal exactly where contents are."""

import random

import numpy as np

from sieveline.llm import stretches
from sieveline.llm.decontaminate import Templates
from sieveline.llm.queries import tokenizer_path
from sieveline.llm.shingles import shingle_sets
from sieveline.llm.token_file import Encoder


def laid(parts):
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def pieces(seed, n):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"ab \x00") for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]) if rng.random() < 0.2 else rng.randint(0, 5))) for _ in range(n)]


def test_codes_and_rows_are_those_of_contents():
    memory, seen = stretches.Memory(), {}
    for seed in range(30):
        parts = pieces(seed, 300)
        data, at = laid(parts)
        codes, content, of = stretches.distinct(data, at[:-1], at[1:])
        named = [content[of[c] : of[c + 1]].tobytes() for c in codes.tolist()]
        assert named == parts and len(of) - 1 == len(set(parts))
        rows, new = memory(content, of, 0)
        assert (rows >= 0).all() and len(set(rows.tolist())) == len(rows)
        for k, row in enumerate(rows.tolist()):
            word = content[of[k] : of[k + 1]].tobytes()
            assert seen.setdefault(word, row) == row and (k in new.tolist()) == (row >= len(memory) - len(new))
    assert len(memory) == len(seen)


def test_a_memory_compares_contents(monkeypatch):
    monkeypatch.setattr(stretches, "hashes", lambda data, start, end: np.full(len(start), 5, np.uint64))
    memory = stretches.Memory()
    one, two = laid([b"one"]), laid([b"two"])
    assert memory(*one)[0].tolist() == [0] and memory(*two)[0].tolist() == [-1] and memory(*one)[0].tolist() == [0]
    encode = Encoder(tokenizer_path())
    texts = ["alpha beta gamma", "beta delta", "alpha alpha"]
    got = encode(*laid([t.encode() for t in texts]))
    assert [g.tolist() for g in got] == [encode.whole(t).tolist() for t in texts]
    template = Templates()
    hashes = template(*laid([b"alpha beta alpha gamma"]))[0].tolist()
    assert len(set(hashes)) == 3 and hashes[0] == hashes[2]


def test_words_that_collide_in_polynomials_are_told_apart():
    """A Thue-Morse word of 2048 letters and its complement: equal under every polynomial modulo 2**64."""
    line = "a"
    while len(line) < 2048:
        line += line.translate(str.maketrans("ab", "ba"))
    other = line.translate(str.maketrans("ab", "ba"))
    data, at = laid([line.encode(), other.encode()])
    a, b = shingle_sets(data, at)
    assert a.tolist() != b.tolist()
    encode = Encoder(tokenizer_path())
    for text in (line, other):
        assert [x.tolist() for x in encode(*laid([f"x {line} y".encode(), f"x {text} y".encode()]))] == [encode.whole(f"x {t} y").tolist() for t in (line, text)]
    template = Templates()
    hashes = template(*laid([f"{line} {other}".encode()]))[0]
    assert hashes[0] != hashes[1]
