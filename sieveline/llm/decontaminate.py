"""Operator 8: benchmark decontamination by template canonicalisation.

Texts become templates: numbers (also English number words and those glued to a unit or to signs of arithmetic), names, and units
beside a number turn into typed placeholders, other words are lower-cased without the signs around them. Windows of WIDTH template words are hashed and joined with those of the
benchmark; an item of fewer words is one window. Windows carry their places in document and item,
so that occurrences of an item are told apart, and windows count as far as they bind slots consistently within an
occurrence: one value of the item's slots may stand for only one value there. So a question with other numbers or names
is found, also beside further copies, and a chance meeting of placeholders is not. A window with names is hashed with the names as plain words
too, as case and the words before decide what is a name. A window with names needs PROSE plain words to count as a template, one of numbers and units only FEW, signs of arithmetic among them; an enumeration
with fewer asks nothing by itself: it is hashed with the values of its slots and found as an exact copy. An item is held where half of its
templates or of all its windows are found, or RUN windows in a row.

Before the join a bit table of fixed size, filled from the benchmark's hashes, drops windows that
cannot match; it loses no match, and the join compares hashes in full and templates by slots.

Defined results: null and empty texts match nothing; items of fewer than ALONE words are held by documents
that consist of them; each letter of a script without spaces is a word; rows that repeat a doc_id count as one document. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import sketch
from sieveline.llm.common import chunks, ints, keep_ids, mapped, staged, text_buffers
from sieveline.llm.shingles import word_spans
from sieveline.llm.stretches import Memory, distinct, mix

WIDTH, PROSE, FEW = 8, 5, 2
#: log2 of the bits that filter windows before the join: a broadcast of 512 KB.
FILTER_BITS = 22
#: An item is leaked when this share of its windows is found, and SEEN of them at least (or all); or RUN windows in a row.
SHARE, SEEN, RUN = 0.5, 3, 18
#: Items of fewer words are only held by texts that are nothing else.
ALONE = 3
#: Words that measure.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec secs min mins h hr hrs day days week weeks month months year years hour hours minute minutes second seconds mile miles meter meters metre metres inch inches foot feet dollar dollars cent cents euro euros percent mph kmh kph usd eur gbp watt watts volt volts".split())
#: Number words with their digits.
NUMBER_WORDS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBER_WORDS |= {w: str(10 * n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety hundred".split(), 2)} | {"thousand": "1000", "million": "1000000"}
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
#: Numbers, letters and signs of a token that may be glued together.
_GLUED = re.compile(r"\d[\d.,:]*|[^\W\d_]+|[^\d]")
_ENDS = re.compile(r"[.!?:]['\")\]]*$")
_SIGNS = ".,;:!?\"'()[]{}<>*_#&|~`…“”‘’。、，．！？：；「」『』（）《》〈〉【】"
#: Letters of scripts that write no spaces: each is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\U00020000-\U0003fa1f])")
#: Tokens that a Python worker remembers before it starts anew.
REMEMBERED = 250_000
_PLACE = np.random.default_rng(99).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
#: Kinds of template words.
SIGN, WORD, NUMBER, NAME, UNIT = -1, 0, 1, 2, 3
_KIND_HASH = {NUMBER: 0x6E756D, NAME: 0x6E616D65, UNIT: 0x756E6974}


#: Forms of a window: its template, the template with names as plain words, or all its words as they are.
TEMPLATE, NAMED, LITERALLY = 0, 1, 2


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of the texts with spaces around letters of scripts that write none."""
    data = raw[int(offsets[0]) : int(offsets[-1])]
    if not ((data >= 0xE0) & (data != 0xE2)).any():
        return raw, offsets
    texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    texts = [t if t.isascii() else _UNSPACED.sub(r" \1 ", t.decode("utf-8", "replace")).encode() for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _typed(core: str) -> tuple[int, str]:
    if _NUMBER.match(core):
        return NUMBER, core
    if core in NUMBER_WORDS:
        return NUMBER, NUMBER_WORDS[core]
    return (UNIT if core in UNITS else WORD if any(c.isalnum() for c in core) else SIGN), core


def template_words(token: str) -> list[tuple[int, str]]:
    """(kind, lower-cased content) of the template words of a token: none if it is signs only, several where numbers are glued to units, single letters or signs, or number words to each other."""
    core = token.strip(_SIGNS).lower()
    if not core:
        return []
    kind, content = _typed(core)
    if kind != WORD:
        return [(kind, content)]
    if core[0].isdigit() or any(c.isdigit() for c in core):
        parts = _GLUED.findall(core)
        if all(len(x) == 1 or x[0].isdigit() or x in UNITS for x in parts):
            return [_typed(x.rstrip(".,:") or x) for x in parts if x not in _SIGNS]
    elif "-" in core:
        parts = core.split("-")
        if all(x in NUMBER_WORDS for x in parts):
            return [_typed(x) for x in parts]
    return [(WORD, core)]


class Templates:
    """Template words of texts as hashes and kinds. What a token gives is remembered, and found by its content."""

    def __init__(self):
        self.memory = Memory()
        # Template words of remembered tokens, where those of each token begin, and what holds for tokens.
        self.hash, self.word, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.at, self.title, self.ends = np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def _learn(self, tokens: list[str]) -> None:
        parts = [template_words(t) for t in tokens]
        flat = [x for p in parts for x in p]
        word = [hash_text(w) for _, w in flat]
        own = [_KIND_HASH.get(k) or w for (k, _), w in zip(flat, word)]
        cores = [t.strip(_SIGNS) for t in tokens]
        title = [len(p) == 1 and p[0][0] == WORD and len(c) > 1 and c[0].isupper() and c[1:].islower() for p, c in zip(parts, cores)]
        ends = [not c or bool(_ENDS.search(t)) for t, c in zip(tokens, cores)]
        put = lambda old, new: np.concatenate([old, np.array(new, old.dtype)])
        self.hash, self.word, self.kind = put(self.hash, own), put(self.word, word), put(self.kind, [k for k, _ in flat])
        self.at = put(self.at, self.at[-1] + np.cumsum([len(p) for p in parts], dtype=np.int64))
        self.title, self.ends = put(self.title, title), put(self.ends, ends)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """(hashes, kinds, word hashes, first template word of each text, text of a template word) for texts raw[offsets[i]:offsets[i+1]].

        A title-case word is a name unless it opens a sentence; a unit is one behind a number only.
        """
        if max(len(self.memory), len(self.hash)) > REMEMBERED:
            self.__init__()
        raw, offsets = spaced(raw, offsets)
        low = int(offsets[0])
        data, at = raw[low : int(offsets[-1])], offsets - low
        start, end = word_spans(data, at)
        codes, contents, of = distinct(data, start, end)
        token = lambda k: data[start[k] : end[k]].tobytes().decode("utf-8", "replace")
        rows, new = self.memory(contents, of)
        if len(new):
            text = contents.tobytes()
            self._learn([text[a:b].decode("utf-8", "replace") for a, b in zip(of[new].tolist(), of[new + 1].tolist())])
        for k in np.flatnonzero(rows < 0).tolist():
            # Another token holds its 64 bits: it is learned under a row that is not looked up again.
            rows[k] = self.memory.apart()
            self._learn([contents[of[k] : of[k + 1]].tobytes().decode("utf-8", "replace")])
        row = rows[codes]
        first = np.searchsorted(start, at)
        opens = np.ones(len(row), bool)
        opens[1:] = self.ends[row][:-1]
        opens[first[:-1][first[:-1] < len(row)]] = True
        # A token's template words in place of it.
        upto = np.concatenate([[0], np.cumsum(self.at[row + 1] - self.at[row])])
        owner = np.repeat(np.arange(len(row)), np.diff(upto))
        part = np.arange(len(owner)) - upto[owner]
        flat = self.at[row[owner]] + part
        kind, hashes, word = self.kind[flat], self.hash[flat], self.word[flat]
        first = upto[first]
        name = (self.title[row] & ~opens)[owner]
        beside = np.zeros(len(kind), bool)
        beside[1:] = kind[:-1] == NUMBER
        beside[first[:-1][first[:-1] < len(kind)]] = False
        loose = (kind == UNIT) & ~beside
        kind[name], hashes[name] = NAME, _KIND_HASH[NAME]
        kind[loose], hashes[loose] = WORD, word[loose]
        return mix(hashes), kind, mix(word), first, lambda k: template_words(token(owner[k]))[part[k]][1].replace("\x1f", " ")


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def template_windows(hashes: np.ndarray, kinds: np.ndarray, words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, text, form) of the windows of `width` template words that lie within one text.

    A window with names is taken with them as plain words too, so that case and the sentence's start cannot hide a copy.
    Windows with too few plain words, names among them, for a template are taken word by word.
    """
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    rolled, plain, names, signs = np.zeros(n, np.uint64), np.zeros(n, np.int8), np.zeros(n, np.int8), np.zeros(n, np.int8)
    for j in range(width):
        rolled += hashes[j : j + n] * _PLACE[j]
        plain += kinds[j : j + n] == WORD
        names += kinds[j : j + n] == NAME
        signs += kinds[j : j + n] == SIGN
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + width <= first[owner + 1]
    if width < ALONE:
        inside &= np.diff(first)[owner] == width
    few = min(FEW, width)
    asks = np.where(names > 0, plain >= min(PROSE, width), (plain > 0) & (plain + signs >= few))
    by_name = (names > 0) & (plain + names + signs >= few)

    def taken(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum((of[at + j] * _PLACE[j] for j in range(width)), np.zeros(len(at), np.uint64))

    template, named, literal = (np.flatnonzero(inside & x) for x in (asks, by_name, ~asks & ~by_name))
    at = np.concatenate([template, named, literal])
    form = np.repeat(np.array([TEMPLATE, NAMED, LITERALLY], np.int8), [len(template), len(named), len(literal)])
    caseless = np.where(kinds == NAME, words, hashes) if len(named) else hashes
    return mix(np.concatenate([rolled[template], taken(caseless, named), taken(words, literal)]) + np.uint64(width)), at, owner[at], form


def _windows(bits: np.ndarray | None, widths: list[int]):
    """Mapper over (id, row, text): usable windows with their place; of documents (bits given) those that the bit table lets pass, of items with the item's size and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Templates()
        for batch in batches:
            ids, keys = ints(batch.column(0)), ints(batch.column(1))
            raw, offsets = text_buffers(batch.column(2))
            for a, b in chunks(offsets):
                hashes, kinds, words, first, value = template(raw, offsets[a : b + 1])
                found: list[tuple] = []
                for width in widths:
                    h, at, text, form = template_windows(hashes, kinds, words, first, width)
                    size = np.diff(first)[text]
                    if bits is None:
                        # An item of fewer words than WIDTH is one window of its own width.
                        keep = np.flatnonzero((size >= WIDTH) if width == WIDTH else (size == width))
                    else:
                        keep = np.flatnonzero(bits[sketch.slots(h, FILTER_BITS)])
                    text, form = text[keep], form[keep]
                    slots = ["\x1f".join(f"{kinds[k]}{value(k)}" for k in range(x, x + width) if kinds[k] > 0 and f != LITERALLY and (f != NAMED or kinds[k] != NAME)) for x, f in zip(at[keep].tolist(), form.tolist())]
                    usable = lambda forms: np.bincount(np.unique(np.stack([text, at[keep]])[:, np.isin(form, forms)], axis=1)[0], minlength=b - a)[text] if bits is None else text  # noqa: B023, E731
                    found.append((ids[a:b][text], keys[a:b][text], h[keep].view(np.int64), at[keep] - first[text], slots, np.full(len(keep), width, np.int32), size[keep], form, usable([TEMPLATE]), usable([TEMPLATE, NAMED]), usable([TEMPLATE, NAMED, LITERALLY])))
                cells = [[x for f in found for x in f[4]] if k == 4 else np.concatenate([f[k] for f in found]) for k in range(11)]
                cells = cells if bits is None else cells[:5]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if k == 4 else pa.array(c) for k, c in enumerate(cells)], ["id", "row", "hash", "at", "slots", "width", "size", "form", "templates", "named", "windows"][: len(cells)])

    return run


def _consistent(bound: list[tuple], place: np.ndarray, rows: np.ndarray, strict: bool) -> np.ndarray:
    """The matches among rows that bind each value of an item to one value of the document: that with the most windows. strict: all of rows, or none."""
    rows = np.array([r for r in rows.tolist() if len(dict(bound[r])) == len(set(bound[r]))] if not strict else rows, np.int64)
    settled: set[str] = set()
    while True:
        means: dict[str, dict[str, set[int]]] = {}
        for r in rows.tolist():
            for i, d in bound[r]:
                means.setdefault(i, {}).setdefault(d, set()).add(int(place[r]))
        open_ = [i for i, ds in means.items() if len(ds) > 1 and i not in settled]
        if not open_:
            return rows
        if strict:
            return rows[:0]
        i = max(open_, key=lambda i: (len(set().union(*means[i].values())), i))
        d = max(means[i], key=lambda d: (len(means[i][d]), d))
        settled.add(i)
        rows = np.array([r for r in rows.tolist() if all(x != i or y == d for x, y in bound[r])], np.int64)


def judged(at: np.ndarray, item_at: np.ndarray, doc_slots: list[str], item_slots: list[str], form: np.ndarray, size: int, usable: list[int]) -> tuple[int, float] | None:
    """(windows found, share) of one item in one text by its matching windows; None if the text does not hold it.

    usable: the item's windows that are templates, templates at least with names as plain words, and all. The share counts against any.

    Document place minus item place tells occurrences apart. Matches are judged together over the whole text (where no
    slot may clash), over stretches in which less than an item's size was put in or left out, and for each alignment.
    """
    pair = dict.fromkeys(zip(item_slots, doc_slots))
    pair = {k: tuple(sorted({(i, d) for i, d in zip(k[0].split("\x1f"), k[1].split("\x1f")) if i})) for k in pair}
    bound = [pair[k] for k in zip(item_slots, doc_slots)]

    def held(rows: np.ndarray) -> tuple[float, int] | None:
        found = []
        for of, forms in zip(usable, ((TEMPLATE,), (TEMPLATE, NAMED), (TEMPLATE, NAMED, LITERALLY))):
            n = len(np.unique(item_at[rows][np.isin(form[rows], forms)]))
            if n and n / of >= SHARE and (n >= SEEN or n == of):
                found.append((n / of, n))
        return max(found, default=None)

    def in_a_row(rows: np.ndarray) -> bool:
        places = np.unique(item_at[rows])
        return len(places) >= RUN and bool((places[RUN - 1 :] - places[: len(places) - RUN + 1] == RUN - 1).any())

    every = np.arange(len(at))
    if held(every) is None and not in_a_row(every):
        return None
    best = held(_consistent(bound, item_at, every, True))
    if best is None:
        align = at - item_at
        for key in (align // size, (align + size // 2) // size, align):
            order = np.argsort(key, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                run = key is align and in_a_row(rows)
                if held(rows) is not None or run:
                    rows = _consistent(bound, item_at, rows, False)
                    own = held(rows)
                    if own is None and run and in_a_row(rows):
                        n = len(np.unique(item_at[rows]))
                        own = (n / usable[-1], n)
                    best = max(best or own, own) if own else best
    return best and (best[1], best[0])


def _judge(met: pa.Table) -> pa.Table:
    """judged() for the matches of one text and one item."""
    cell = lambda name: met.column(name)[0].as_py()
    numbers = lambda name: met.column(name).to_numpy()
    got = judged(numbers("at"), numbers("item_at"), met.column("slots").to_pylist(), met.column("item_slots").to_pylist(), numbers("form"), cell("size"), [cell("templates"), cell("named"), cell("windows")])
    rows = [] if got is None else [{"doc_id": cell("doc_id"), "item_id": cell("item_id"), "n_windows": got[0], "share": got[1]}]
    return pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("share", pa.float64())]))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item found), share (of its windows) for each document that holds an item."""
    # Rows are told apart by a hash of their text, as places count within one text.
    rows = lambda df, key: df.filter(f"{key} is not null").select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    place = "id long, row long, hash long, at long, slots string"
    items = mapped(rows(benchmark, "item_id"), _windows(None, list(range(1, WIDTH + 1))), f"{place}, width int, size long, form byte, templates long, named long, windows long")
    own = staged(items.withColumnsRenamed({"id": "item_id", "row": "item_row", "at": "item_at", "slots": "item_slots"}).distinct())
    counted = sketch.counted(own.select("hash"), lambda batch: iter([batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]), FILTER_BITS)
    # Only widths that some item has are looked for.
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())
    if not widths:
        return documents.sparkSession.sql("SELECT 0L AS doc_id, 0L AS item_id, 0L AS n_windows, 0D AS share WHERE false")
    found = mapped(rows(documents, "doc_id"), _windows(counted > 0, widths), place).withColumnRenamed("id", "doc_id").distinct()
    met = found.join(own, "hash")
    held = met.groupBy("doc_id", "row", "item_id", "item_row").applyInArrow(_judge, "doc_id long, item_id long, n_windows long, share double")
    return held.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "n_windows")).alias("best")).select("doc_id", "item_id", "best.n_windows", "best.share")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item; rows without an id stay."""
    gone = staged(leaks(documents, benchmark).select("doc_id").distinct())
    return keep_ids(documents, gone, "doc_id", "left_anti").select(*documents.columns)
