"""Operator 1: quality classifier on random-indexing word vectors.

A white-space token is read as terms: its lower-cased letters, its case, and the signs before and after
them (runs of one sign as three). A token of over LONGEST characters counts as its successive pieces of that length. Every term has a sparse random index vector; its context vector adds the index vectors of the terms
around it over the training sample (random indexing) to its own. A token's vector is the sum of its terms',
a document's is the mean over its tokens, next to the spread between tokens, the log of their number, their kinds for each token, and the share of the commonest. A
two-layer numpy network scores it; a temperature fitted on a part of the training sample calibrates it.

Words and network are fitted on a bounded sample: SAMPLE labelled rows (the first by hash of doc_id) that
are not held out, of SAMPLE_CHARS characters at most each. Scoring reads every text whole.

Defined results: null and empty texts are scored as documents without tokens; rows with a null or other
label than 0 and 1 teach nothing, nor do ids with both; without any of both labels the score is the share of label 1
(or 0.5). A score of exactly 0.5 is predicted 1. Rows that repeat a doc_id come back once each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import chunks, fold, ints, mapped, text_buffers

SAMPLE, SAMPLE_CHARS = 4000, 40_000
DIM, NONZERO, AROUND = 48, 6, 2
#: Words seen less often in the sample, or beyond the most frequent VOCABULARY, share one vector by length.
SEEN, VOCABULARY = 3, 40_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 4e-3, 1e-4
#: Tokens that a Python worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters of a token that are read as one.
LONGEST = 40
_PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
_RUN = re.compile(r"(.)\1{3,}", re.S)


def tokens_of(text: str) -> list[str]:
    """White-space tokens, longer ones in pieces: nothing of a text is left out."""
    found = text.split()
    if max(map(len, found), default=0) > LONGEST:
        found = [t[k : k + LONGEST] for t in found for k in range(0, len(t), LONGEST)]
    return found


def terms(token: str) -> tuple[str, ...]:
    before, core, after = _PARTS.match(token).groups()
    case = "digits" if core.isdigit() else "lower" if core.islower() else "title" if core.istitle() else "upper" if core.isupper() else "mixed" if core else "signs"
    signs = lambda x: _RUN.sub(r"\1\1\1", x)
    return ("w " + core.lower(), f"c {case}", "b " + signs(before), "a " + signs(after))


def index_vector(term: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(term.encode("utf-8", "surrogatepass")))
    vector = np.zeros(DIM, np.float32)
    vector[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return vector


class Words:
    """Token vectors; those of tokens met before are kept in one growing matrix."""

    def __init__(self, context: dict[str, np.ndarray]):
        self.context, self.rows, self.matrix = context, {}, np.zeros((1024, DIM), np.float32)
        self.loose: dict[str, np.ndarray] = {}

    def _term(self, term: str) -> np.ndarray:
        known = self.context.get(term)
        if known is None:
            if term[0] == "w":
                term = f"w#{min(len(term) - 2, 30)}"
            if (known := self.context.get(term)) is None and (known := self.loose.get(term)) is None:
                if len(self.loose) > 20_000:
                    self.loose.clear()
                known = self.loose[term] = index_vector(term) / np.sqrt(NONZERO)
        return known

    def pooled(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 3), np.float32)
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        for i, text in enumerate(texts):
            tokens = tokens_of(text)
            for t in [t for t in set(tokens) if t not in self.rows]:
                k = self.rows[t] = len(self.rows)
                if k == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[k] = sum(map(self._term, terms(t)))
            if tokens:
                own = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
                kinds, n = np.unique(own, return_counts=True)
                of, share = self.matrix[kinds], (n / len(tokens)).astype(np.float32)
                mean = share @ of
                out[i] = np.concatenate([mean, np.sqrt(np.maximum(share @ of**2 - mean**2, 0)), [np.log1p(len(tokens)), len(kinds) / len(tokens), share.max()]])
        return out


def context_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    """Random indexing over the sample: term -> context vector of length 1."""
    rows: dict[str, int] = {}
    docs = [np.array([rows.setdefault(t, len(rows)) for t in tokens_of(text)], np.int64) for text in texts]
    parts = [terms(t) for t in rows]
    times = np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]), minlength=len(rows)).tolist()
    counts: Counter = Counter()
    for part, n in zip(parts, times):
        for t in part:
            counts[t] += n
    kept = {t for t, n in counts.most_common(VOCABULARY) if n >= SEEN}
    folded = lambda t: t if t in kept else f"w#{min(len(t) - 2, 30)}" if t[0] == "w" else t
    names: dict[str, int] = {}
    of = np.array([[names.setdefault(folded(t), len(names)) for t in part] for part in parts], np.int64).reshape(-1, 4)
    index = np.array([index_vector(t) for t in names], np.float32).reshape(-1, DIM)
    token = index[of].sum(1)
    around = np.zeros_like(token)
    for doc in docs:
        own, near = token[doc], np.zeros((len(doc), DIM), np.float32)
        for d in range(1, AROUND + 1):
            near[d:] += own[:-d]
            near[:-d] += own[d:]
        np.add.at(around, doc, near)
    total = index.copy()
    for j in range(of.shape[1]):
        np.add.at(total, of[:, j], around)
    # A term's own vector weighs as much as all its contexts.
    near = total - index
    total = index / np.sqrt(NONZERO) + near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-6)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
    return dict(zip(names, total))


class Network:
    """Two layers on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.ready = len(set(y.tolist())) == 2 and len(y) >= 20
        self.temperature = 1.0
        if not self.ready:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(y))
        aside, learn = order[: len(y) // 5], order[len(y) // 5 :]
        z = self._scaled(x)
        p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(np.log(self.prior / (1 - self.prior)))]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            learn = rng.permutation(learn)
            for at in range(0, len(learn), BATCH):
                rows = learn[at : at + BATCH]
                h = np.maximum(z[rows] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
                dh = np.outer(d, p[2]) * (h > 0)
                step += 1
                for k, g in enumerate((z[rows].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum())):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        logit, grid = self._logit(x[aside]), np.geomspace(0.25, 16, 61)
        loss = [np.mean(np.logaddexp(0, -(2 * y[aside] - 1) * logit / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(aside) else 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8).astype(np.float64)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._scaled(x) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def trained(documents: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], Network]:
    """Context vectors and network from the bounded sample of labelled rows that are not held out."""
    own = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = own.filter(fold() != 1).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = documents.filter(f"length(text) <= {SAMPLE_CHARS}").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).collect()
    sample, y = [r["text"] for r in rows], np.array([r["quality"] for r in rows], np.float64)
    context = context_vectors(sample)
    return context, Network(Words(context).pooled(sample), y)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted."""
    context, network = trained(documents, labels)
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast((list(context), np.array(list(context.values()), np.float32), network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, score = model.value
        words = Words(dict(zip(names, vectors)))
        for batch in batches:
            ids = ints(batch.column(0))
            _, at = text_buffers(batch.column(2))
            texts = batch.column(2).fill_null("")
            for a, b in chunks(at):
                p = score(words.pooled(texts.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], mask=ids[a:b] == -(2**63)), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")
