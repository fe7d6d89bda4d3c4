"""Operator 2: language identification with hyperdimensional profiles.

Every lower-cased letter has a random bipolar vector of its own, drawn from a seed and its code point. A trigram's vector
binds its letters' vectors after permuting (rolling) them by their place, a document's bundles those of all its trigrams,
and a language's prototype bundles its training documents, each scaled to one length and rounded so that
sums are exact integers whatever the order of tasks. The mean of all prototypes is taken from both sides before the
cosine; the score is the share of the best language in a softmax of cosines.

Defined results: a text that is null or has no letter is `und` with score 0; letters are those that
str.isalpha() knows, lower-cased; anything else ends a word; ties go to the language first by code point.
Without training rows everything is `und`; an empty table gives an empty result. Rows that repeat a doc_id come back
once each (and teach once each); texts of any length are read whole, extra columns are ignored. lang, source
and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.batches import KEPT
from sieveline.llm.common import bounded, chunks, fold, ints, mapped, releasing, text_buffers

#: Length of vectors; steepness of the softmax.
DIM, SHARP = 512, 24.0
UNKNOWN = "und"
#: A document of FEWEST trigrams or more is rejected when its profile is no nearer to any prototype than chance: cosines of unrelated vectors have a deviation of DIM ** -0.5.
CHANCE, FEWEST = 2.0, 40
#: Letters of text and texts that are bundled together; distinct trigrams whose vectors are made at a time.
TOGETHER_LETTERS, TOGETHER, SLICE = 1 << 18, 256, 2048
_SCALE = 1000
_EDGE = 0


class Letters:
    """Dense numbers and vectors of the letters met so far; number 0 is a word's edge."""

    def __init__(self):
        self.lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                self.lower[c] = ord(x.lower()[0])
        self.number = np.full(0x110000, -1, np.int32)
        self.number[0] = _EDGE
        self.vectors = self._drawn(0)[None]

    @staticmethod
    def _drawn(point: int) -> np.ndarray:
        return np.random.default_rng([7, point]).choice(np.array([-1, 1], np.int8), DIM)

    def numbered(self, points: np.ndarray) -> np.ndarray:
        """Numbers of code points; 0 for what is no letter."""
        low = self.lower[points]
        found = self.number[low]
        if len(found) and found.min() < 0:
            new = np.unique(low[found < 0])
            self.number[new] = len(self.vectors) + np.arange(len(new))
            self.vectors = np.concatenate([self.vectors, [self._drawn(int(c)) for c in new]])
            found = self.number[low]
        return found


_LETTERS: list[Letters] = []
KEPT[__name__] = _LETTERS.clear


def _letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def _counted(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them) of values below top."""
    if top > 1 << 22:
        return np.unique(values, return_inverse=True)
    present = np.zeros(top, bool)
    present[values] = True
    return np.flatnonzero(present), (np.cumsum(present) - 1)[values]


def _bundles(texts: list[str]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, bundle of length 1, number of trigrams) for each text that has a letter, over a few texts at a time, or over the segments of a longer text."""
    size = np.array([len(t) for t in texts], np.int64)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(np.cumsum(size[first : first + TOGETHER]), TOGETHER_LETTERS, side="right"))
        last = min(len(texts), first + max(last, 1))
        if size[first] > TOGETHER_LETTERS:
            text, sums, count = texts[first], 0.0, 0
            for at in range(0, len(text), TOGETHER_LETTERS):
                part = text[at : at + TOGETHER_LETTERS]
                own, n = _totals([part], text[at - 1] if at else "\n", text[at + len(part) : at + len(part) + 1] or "\n")
                sums, count = sums + own, count + n
        else:
            sums, count = _totals(texts[first:last], "\n", "\n")
        for row in np.flatnonzero(count).tolist():
            yield first + row, sums[row] / max(float(np.sqrt(sums[row] @ sums[row])), 1e-9), int(count[row])
        first = last


def _totals(texts: list[str], before: str, after: str) -> tuple[np.ndarray, np.ndarray]:
    """(sum of its trigrams' vectors, number of trigrams) of each text; before and after stand beside the first and the last one.

    Distinct trigrams are taken SLICE at a time, so that memory follows neither their number nor the alphabet.
    """
    of = _letters()
    sums, size = np.zeros((len(texts), DIM)), np.zeros(len(texts), np.int64)
    # A sign that is no letter stands between texts.
    points = np.frombuffer((before + "\n".join(texts) + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = of.numbered(points)
    centre = np.flatnonzero(found[1:-1] > 0) + 1
    if not len(centre):
        return sums, size
    known, line = _counted(found, len(of.vectors))
    n = len(known)
    # What stands beside a word is number 0, whatever it is.
    codes, place = _counted((line[centre - 1].astype(np.int64) * n + line[centre]) * n + line[centre + 1], n**3)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), centre, side="left")
    size += np.bincount(text, minlength=len(texts))
    met = np.sort(place * len(texts) + text)
    starts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
    times = np.diff(np.append(starts, len(met)))
    place, text = np.divmod(met[starts], len(texts))
    vectors = lambda k: of.vectors[known[k]]
    for a in range(0, len(codes), SLICE):
        part = codes[a : a + SLICE]
        bound = vectors(part // n**2) * np.roll(vectors(part // n % n), 1, axis=1) * np.roll(vectors(part % n), 2, axis=1)
        low, high = np.searchsorted(place, [a, a + SLICE])
        counts = np.zeros((len(texts), len(part)), np.float32)
        counts[text[low:high], place[low:high] - a] = times[low:high]
        # Exact: whole numbers below 2**24.
        sums += counts @ bound.astype(np.float32)
    return sums, size


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    _, at = text_buffers(column)
    texts = column.fill_null("")
    for a, b in chunks(at):
        yield a, texts.slice(a, b - a).to_pylist()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper over (lang, text): the sum of rounded bundles by language, one number a row."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in _pieces(batch.column(1)):
            for row, bundle, _ in _bundles(texts):
                lang = langs[first + row]
                total[lang] = total.get(lang, 0) + np.rint(bundle * _SCALE).astype(np.int64)
    for lang, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(vector)], ["lang", "i", "v"])


class Prototypes:
    """Languages in order of code points, their summed profiles of length 1, the mean of these, and the profiles without it."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.langs = sorted(sums, key=lambda x: x.encode())
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        self.whole = unit(np.array([sums[x] for x in self.langs], np.float64).reshape(-1, DIM))
        self.mean = self.whole.mean(0) if len(self.langs) > 1 else np.zeros(DIM)
        self.centred = unit(self.whole - self.mean)


def trained(documents: DataFrame) -> Prototypes:
    """Prototypes from all documents that are not held out and have a language."""
    learn = documents.filter((fold() != 1) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = mapped(learn, _summed, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    # A row of DIM numbers for each language, however many documents there are.
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vector")).collect()
    return Prototypes({r["lang"]: np.array([x["v"] for x in r["vector"]], np.float64) for r in rows})


def predict(texts: list[str], of: Prototypes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, whether it is like any language) of each text."""
    out, score, like = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if of.langs:
        for row, bundle, n in _bundles(texts):
            apart = bundle - of.mean
            cosine = of.centred @ apart / max(float(np.sqrt(apart @ apart)), 1e-9)
            share = np.exp(SHARP * (cosine - cosine.max()))
            best = int(np.argmax(share))
            out[row], score[row] = of.langs[best], share[best] / share.sum()
            like[row] = n < FEWEST or (of.whole @ bundle).max() >= CHANCE / np.sqrt(DIM)
    return out, score, like


def identified(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score."""
    prototypes = trained(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ints(batch.column(0))
            for first, texts in _pieces(batch.column(2)):
                lang, score, _ = predict(texts, prototypes)
                part = slice(first, first + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part], mask=ids[part] == -(2**63)), batch.column(1).slice(first, len(texts)), pa.array(lang), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(documents: DataFrame) -> DataFrame:
    """documents (their own columns) whose language is known: not `und`, and (from FEWEST trigrams on) nearer to some prototype than chance, however many languages there are.

    Rows keep their own columns and repeats; null and empty texts go; of an empty table or one without training rows nothing is left.
    """
    prototypes = trained(documents)

    def known(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in series:
            keep = [np.zeros(0, bool)]
            for _, texts in _pieces(column):
                keep.append(predict(texts, prototypes)[2])
            yield pa.array(np.concatenate(keep).astype(bool))

    bounded(documents.sparkSession)
    return documents.filter(F.arrow_udf(releasing(known), "boolean")(F.col("text").cast("string")))
