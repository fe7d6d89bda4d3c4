"""Operator 6: secret scan with a random forest that removes false positives.

Candidates are key-like assignments (`token = "..."`), values with a known prefix, and long runs of key
characters. Each has features: its length and the classes of its characters, how likely its character
transitions are in words, how much of it dictionary pieces cover, the words around it (key names, names
of checksums), and its path where there is one. A random forest, grown in numpy from labelled findings that
a seeded generator writes, scores it; a candidate is a finding from THRESHOLD on.

The dictionary is bounded and learned: the letter pairs and the words of the generator's prose, and of
each document the words that it uses more than once outside of candidates.

Defined results: null and empty texts have no findings, nor has an empty table; a document without findings has no row;
names and values of any length are taken whole; offsets are code points, end exclusive; where candidates overlap,
assignments go before prefixes, these before runs, and earlier ones first; rows that repeat a doc_id are scanned each
for itself. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import chunks, ints, mapped, text_buffers

LEAST = 16
THRESHOLD = 0.5
TREES, DEPTH, LEAF, TRAIN = 40, 9, 4, 4000

_VALUE = r"[A-Za-z0-9+/_=.~-]"
#: Signs of key names, and a sign of assignment with the value, with or without quotes.
_NAME = re.compile(r"[A-Za-z0-9_.-]*")
_NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_KEY = re.compile(r"(?i)token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth")
_VALUED = re.compile(rf"[\"']?\s*(?:=>|:=|=|:)\s*[\"']?({_VALUE}{{8,}})")
_PREFIXED = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk-[A-Za-z0-9]{20,}|\bAIza[A-Za-z0-9_-]{35}|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CUE = re.compile(r"(?i)token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth")
_SUM = re.compile(r"(?i)sha-?\d*|md5|checksum|digest|commit|hash|etag|revision|uuid|guid|blob|build")
_EXAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|<|\$\{")
_PATH = re.compile(r"(?i)(?:^|[\s\"'(])((?:[\w.-]+/)+[\w.-]+)\b")
_TESTS = re.compile(r"(?i)(?:^|/)(?:tests?|fixtures?|examples?|docs?|samples?)/")

FEATURES = ["length", "digits", "upper", "lower", "signs", "hex", "entropy", "transition", "covered", "switches", "cue", "sum", "example", "assigned", "prefixed", "quoted", "path", "test_path", "distinct"]


def assignments(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, key name) of the values of names that hold a key word; each run of name signs is looked at once."""
    at = 0
    while key := _KEY.search(text, at):
        first, last = key.start(), _NAME.match(text, key.end()).end()
        while first > at and text[first - 1] in _NAME_SIGNS:
            first -= 1
        value = _VALUED.match(text, last)
        if value:
            yield value.start(1), value.end(1), text[first:last].lstrip(".-")
        at = value.end(1) if value else last


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key name), without overlap: assignments first, then prefixes, then runs."""
    found: list[tuple[int, int, str, str]] = []  # kept in order of start

    def add(a: int, b: int, kind: str, name: str) -> None:
        k = bisect(found, (a,))
        if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or found[k][0] >= b):
            found.insert(k, (a, b, kind, name))

    for a, b, name in assignments(text):
        add(a, b, "assigned", name)
    for m in _PREFIXED.finditer(text):
        add(m.start(), m.end(), "prefixed", "")
    for m in _RUN.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            add(m.start(), m.end(), "run", "")
    return found


def prose(rng: np.random.Generator, n: int) -> list[str]:
    """Words of syllables, as of natural text."""
    starts, vowels, ends = ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "th", "st", "tr", "sh", "w", ""], ["a", "e", "i", "o", "u", "ea", "io", "ou"], ["", "", "n", "r", "s", "t", "nd", "ng", "ble", "ly", "ed"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    return ["".join(pick(starts) + pick(vowels) + pick(ends) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]


class Dictionary:
    """Log odds of letter pairs in words against even letters, and pieces of words."""

    def __init__(self, words: list[str]):
        pairs = Counter(a + b for w in words for a, b in zip(w, w[1:]))
        total = sum(pairs.values())
        self.pairs = {p: math.log((n + 0.5) / (total + 338) * 676) for p, n in pairs.items()}
        self.unseen = math.log(0.5 / (total + 338) * 676)
        self.pieces = {w[i : i + 4] for w in words for i in range(len(w) - 3)}

    def transition(self, text: str) -> float:
        low = text.lower()
        pairs = [self.pairs.get(a + b, self.unseen) for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
        return sum(pairs) / len(pairs) if pairs else self.unseen

    def covered(self, text: str, own: set[str]) -> float:
        low, hit = text.lower(), 0
        at = 0
        while at + 4 <= len(low):
            if low[at : at + 4] in self.pieces or low[at : at + 4] in own:
                hit += 4
                at += 4
            else:
                at += 1
        return hit / max(1, len(low))


def features(text: str, a: int, b: int, kind: str, name: str, of: Dictionary, own: set[str]) -> list[float]:
    value, n = text[a:b], b - a
    before, after = text[max(0, a - 60) : a], text[b : b + 30]
    count = Counter(value)
    groups = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    path = _PATH.search(before + value)
    return [
        min(n, 200), sum(g == 0 for g in groups) / n, sum(g == 1 for g in groups) / n, sum(g == 2 for g in groups) / n, sum(g == 3 for g in groups) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), -sum(k / n * math.log2(k / n) for k in count.values()), of.transition(value), of.covered(value, own),
        sum(x != y for x, y in zip(groups, groups[1:])) / n, float(bool(_CUE.search(name or before[-30:]))), float(bool(_SUM.search(before[-30:]))),
        float(bool(_EXAMPLE.search(value) or _EXAMPLE.search(after[:8]))), float(kind == "assigned"), float(kind == "prefixed"), float(before[-1:] in "\"'" and bool(before)),
        float(bool(path)), float(bool(path and _TESTS.search(path[1]))), len(count) / n,
    ]


def labelled(seed: int, n: int) -> tuple[list[tuple[str, int, int, str, str]], np.ndarray]:
    """n labelled findings: (text, start, end, kind, key name), and whether each is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chars = lambda of, k: "".join(of[int(i)] for i in rng.integers(0, len(of), k))
    hexes, wide = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, y = [], []
    while len(rows) < n:
        words = prose(rng, 24)
        secret = rng.random() < 0.5
        lead, tail = " ".join(words[:8]), " ".join(words[8:14])
        key = pick("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "TOKEN")
        if secret:
            value = pick(chars(hexes, pick(32, 40, 64)), chars(hexes, 40).upper(), chars(wide, int(rng.integers(20, 48))), chars(wide + "+/", 40), "AKIA" + chars(wide[:26] + "0123456789", 16), "ghp_" + chars(wide, 36), "sk-" + chars(wide, 32))
            known = value.startswith(("AKIA", "ghp_", "sk-"))
            shape = pick('{k} = "{v}"', "{k}: {v}", "{k}='{v}'", '{k} = "{v}"!!', '"{k}": "{v}"') if not known or rng.random() < 0.6 else "{v}"
        else:
            value = pick(
                "".join(words[14:18])[:40] + "1", "-".join(words[14:18]), "_".join(words[14:19]) + "_2", chars(hexes, pick(32, 40, 64)), f"{chars(hexes, 8)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 12)}",
                "your_api_key_goes_here_1", "xxxxxxxxxxxxxxxxxxxxxxxx1", "/".join(words[14:18]) + "/v2", chars("0123456789", 18) + "a", "A" * 24 + "1", "changeme_changeme_1",
            )
            random = all(c in hexes + "-" for c in value)
            shape = pick("commit {v}", "sha256: {v}", "md5 {v}", 'checksum = "{v}"', "digest {v}", "uuid {v}", "build {v}", 'etag: "{v}"') if random else pick("{v}", "see {v}", '{k} = "{v}"', "{k}: {v}", "tests/fixtures/key.txt {v}")
        text = f"{lead} {shape.format(k=key, v=value)} {tail}"
        at = text.index(value)
        for a, b, kind, name in candidates(text):
            if a <= at < b:
                rows.append((text, a, b, kind, name))
                y.append(secret)
                break
    return rows, np.array(y, bool)


class Forest:
    """Decision trees on bootstrap samples, each split drawn from a random subset of features; arrays of nodes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.trees = [self._grown(x[s], y[s], rng) for s in (rng.integers(0, len(y), len(y)) for _ in range(trees))]

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
        best = (1e-9, -1, 0.0)
        whole = len(y) * y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            left = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (left >= LEAF) & (len(y) - left >= LEAF)
            if cut.any():
                p, q = hits[:-1] / left, (hits[-1] - hits[:-1]) / (len(y) - left)
                gain = np.where(cut, whole - left * p * (1 - p) - (len(y) - left) * q * (1 - q), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
        return best

    def _grown(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Rows (feature or -1, threshold, left, right, share of secrets)."""
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, 0, 0, float(y[rows].mean())])
            if depth < DEPTH and 0 < nodes[at][4] < 1:
                _, f, cut = self._split(x[rows], y[rows], rng)
                if f >= 0:
                    low = x[rows, f] <= cut
                    nodes[at][:4] = [f, cut, grow(rows[low], depth + 1), grow(rows[~low], depth + 1)]
            return at

        grow(np.arange(len(y)), 0)
        return np.array(nodes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = tree[at, 0].astype(np.int64)
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(f < 0, at, np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64))
            total += tree[at, 4]
        return total / len(self.trees)


_MODEL: dict[str, tuple[Dictionary, Forest]] = {}


def trained() -> tuple[Dictionary, Forest]:
    """Dictionary and forest, fitted once in a driver process on TRAIN labelled findings."""
    if "secrets" not in _MODEL:
        of = Dictionary(prose(np.random.default_rng(1), 4000))
        rows, y = labelled(41, TRAIN)
        x = np.array([features(*row, of, set()) for row in rows])
        _MODEL["secrets"] = (of, Forest(x, y.astype(float)))
    return _MODEL["secrets"]


def scan(text: str, of: Dictionary, forest: Forest) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, key name, score) of all candidates of a text."""
    found = candidates(text)
    if not found:
        return []
    # Words of the text around the candidates, so that a repeated secret is not its own dictionary.
    around = " ".join(text[a:b] for a, b in zip([0, *(c[1] for c in found)], [*(c[0] for c in found), len(text)]))
    uses = Counter(w.lower() for w in re.findall(r"[^\W\d_]{4,}", around))
    own = {w[i : i + 4] for w, n in uses.items() if n > 1 for i in range(len(w) - 3)}
    p = forest(np.array([features(text, *c, of, own) for c in found]))
    return [(*c, float(s)) for c, s in zip(found, p)]


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, key_name, score: a row for each secret."""
    model = documents.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ints(batch.column(0))
            _, at = text_buffers(batch.column(1))
            column = batch.column(1).fill_null("")
            for a, b in chunks(at):
                rows = [(i, *f) for i, text in zip(ids[a:b].tolist(), column.slice(a, b - a).to_pylist()) for f in scan(text, *model.value) if f[-1] >= THRESHOLD]
                cells = list(zip(*rows)) if rows else [()] * 6
                doc = np.array(cells[0], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == -(2**63)), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.int64()), pa.array(cells[3], pa.string()), pa.array(cells[4], pa.string()), pa.array(np.round(np.array(cells[5], np.float64), 6))],
                    ["doc_id", "start", "end", "kind", "key_name", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, start long, end long, kind string, key_name string, score double")
