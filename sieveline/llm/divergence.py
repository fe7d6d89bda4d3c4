r"""Operator 13: source divergence audit with a two-pass vocabulary automaton.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. The first pass counts exactly in how many documents of a language a term
occurs; terms in at least LEAST_DOCUMENTS are kept. The second pass reads the texts again with an Aho-Corasick automaton of each language's kept terms, each
padded with a delimiter on both sides, over texts whose delimiters are all that one: matches are whole terms, and each task adds its
occurrences up by source before they are shuffled.

Kept terms grow with the corpus, an automaton in every worker must not. It holds the AUTOMATON most widespread terms of up to TERM_CHARS characters, over all languages;
occurrences of any further kept term are counted by aggregating and joining terms, which is as exact.

A group (language and source) gives each kept term p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), in decimals. Its postings are sparse: a
term that it lacks has the group's base value p(0). The distance of two sources is V times that of their bases plus, for the terms that either has, what differs from
it. Blocks of BLOCK sources meet pairwise, by slices of SLICE terms, in matrices of bounded size; no row for two sources of a term is ever made.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_IDS, bounded, chunks, mapped, staged, text_buffers

LEAST_DOCUMENTS, SMOOTH, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: Terms that the automata of a worker hold at most over all languages (some 100 MB), and the longest of them.
AUTOMATON, TERM_CHARS = 400_000, 64
#: Sources and terms of a matrix.
BLOCK, SLICE = 128, 1024
#: (source, term) counts that a task holds before it hands them on.
HELD = 400_000
DELIMITERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = frozenset(string.ascii_letters.encode())
#: Bytes of UTF-8 to themselves, A-Z to a-z, delimiters (all of them ASCII) to a blank.
_PLAIN = bytes(b if b > 0x7F else ord(chr(b).lower()) if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, DELIMITERS), lambda x: x != "")


def vocabulary(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, docs, id of the kept terms, staged. documents: lang, source, text without nulls."""
    each = documents.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    kept = each.groupBy("lang", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)
    return staged(kept.withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def occurrences(documents: DataFrame, kept: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """lang, source, id, n (over 0) of the kept terms."""
    fitting = kept.filter(F.length("term") <= TERM_CHARS)
    if fitting.count() > most:
        fitting = staged(fitting.orderBy(F.desc("docs"), "lang", "term").limit(most), "automaton")
    words: dict[str, tuple[list[str], list[int]]] = {}
    for batch in fitting.select("lang", "term", "id").toArrow().to_batches():
        for lang, term, k in zip(*[c.to_pylist() for c in batch.columns]):
            held = words.setdefault(lang, ([], []))
            held[0].append(term)
            held[1].append(k)
    shared = documents.sparkSession.sparkContext.broadcast(words)
    # Languages without terms in the automaton need no reading.
    found = mapped(documents.select("lang", "source", "text"), _counting(shared), "lang string, source string, id long, n long")
    rest = kept.join(fitting.select("id"), "id", "left_anti")
    if rest.head(1):
        each = documents.select("lang", "source", F.explode(terms_of(F.col("text"))).alias("term"))
        counts = each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
        found = found.unionByName(counts.join(rest, ["lang", "term"]).select("lang", "source", "id", "n"))
    return found.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))


#: The automata that a worker has built, by broadcast and language; those of an earlier broadcast go.
_BUILT: dict = {}


def automaton(words: tuple[list[str], list[int]]):
    import ahocorasick

    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(words[0]):
        built.add_word(f" {term} ", k)
    built.make_automaton()
    return built


def _counting(shared):
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        if _BUILT.get("of") != key:
            _BUILT.clear()
            _BUILT["of"] = key
        counts: dict[tuple[str, str], Counter] = {}

        def table() -> pa.RecordBatch:
            langs, sources, ids, n = [], [], [], []
            for (lang, source), found in counts.items():
                numbers = words[lang][1]
                langs += [lang] * len(found)
                sources += [source] * len(found)
                ids += [numbers[k] for k in found]
                n += found.values()
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw, at = text_buffers(batch.column(2))
            for first, last in chunks(at):
                plain = raw[at[first] : at[last]].tobytes().translate(_PLAIN)
                for row in range(first, last):
                    lang = langs[row]
                    if lang not in words:
                        continue
                    if lang not in _BUILT:
                        _BUILT[lang] = automaton(words[lang])
                    text = plain[at[row] - at[first] : at[row + 1] - at[first]].decode("utf-8", "surrogateescape")
                    counts.setdefault((lang, sources[row]), Counter()).update(map(itemgetter(1), _BUILT[lang].iter(f" {text} ")))
                if sum(map(len, counts.values())) > HELD:
                    yield table()
                    counts.clear()
        if counts:
            yield table()

    return count


def _probability(n: Column | str, total: str = "total", v: str = "v") -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = whole(n + F.lit(SMOOTH)) * F.lit(UNIT).cast("decimal(10,0)")
    below = whole(F.col(total) + F.lit(SMOOTH) * F.col(v))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def audited(documents: DataFrame, least: int = LEAST_DOCUMENTS, most: int = AUTOMATON, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of lang and source the distance to every other source of the language (part pair), and its terms furthest above the language's p, RANKS at most (part term).

    Null text, lang and source are empty strings. A document is a row; rows that repeat a doc_id count each. A language that keeps no term has pairs of value 0 and no terms; a
    group without terms has the base value for every term. Values that tie are in order of item, in bytes. Texts and terms of any length count whole. An
    empty table gives an empty result; extra columns are ignored.
    """
    docs = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = vocabulary(docs, least)
    counts = staged(occurrences(docs, kept, most), "postings")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    # A row a group, a language: how many sources, blocks of them and slices of terms it has.
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    sized = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sized = staged(sized, "groups")
    many = sized.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total")).join(by_lang, "lang", "left").fillna(0, ["v"])
    blocks, slices = F.ceil(F.col("sources") / block).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("v") / slice_), F.lit(1)).cast("int").alias("slices")
    base = F.when(F.col("v") > 0, _probability(F.lit(0))).otherwise(0)
    about = sized.join(_small(many.select("lang", "lang_total", "v", blocks, slices)), "lang")
    about = staged(about.select("*", base.alias("base"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")), "groups")
    postings = counts.join(_small(about), ["lang", "source"]).withColumn("p", _probability(F.col("n")))
    return _pairs(postings, about).unionByName(_terms(postings, kept))


def _terms(postings: DataFrame, kept: DataFrame) -> DataFrame:
    whole = postings.groupBy("id").agg(F.sum("n").alias("of_lang"), F.max("lang_total").alias("lang_total"), F.max("v").alias("v"))
    q = whole.select("id", _probability(F.col("of_lang"), "lang_total").alias("q")).join(kept.select("id", "term"), "id")
    above = postings.select("lang", "source", "id", "p").join(q, "id").filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(postings: DataFrame, about: DataFrame) -> DataFrame:
    bounded(about.sparkSession)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    slice_ = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    said = postings.select("lang", "source", "block", "id", "p", slice_, other)
    bases = about.select("lang", "source", "block", F.lit(None).cast("long").alias("id"), F.col("base").alias("p"), every, "blocks").select("lang", "source", "block", "id", "p", "slice", other)
    met = said.unionByName(bases).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    parts = met.groupBy("lang", "low", "high", "slice").applyInArrow(_differences, "lang string, source string, item string, d long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("d").alias("d"))
    left = about.select("lang", "source", "v", F.col("base").alias("base_a"), other)
    right = about.select("lang", F.col("source").alias("item"), F.col("base").alias("base_b"), F.col("block").alias("other"))
    pairs = left.join(right, ["lang", "other"]).filter(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    value = F.col("v") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("d", F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return valued.withColumn("rank", F.row_number().over(order))


def _differences(table: pa.Table) -> pa.Table:
    """Of two blocks of sources and a slice of terms: for each two sources, over the terms that any of them has, the sum of |p - q| less that of their bases."""
    of = {n: table.column(n) for n in table.column_names}
    coded = of["source"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    sources, column = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
    is_base = np.asarray(of["id"].is_null())
    p, block = of["p"].to_numpy(), of["block"].to_numpy()
    base, of_block = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    base[column[is_base]], of_block[column] = p[is_base], block
    ids, row = np.unique(of["id"].drop_null().to_numpy(), return_inverse=True)
    dense = np.tile(base, (len(ids), 1))
    dense[row, column[~is_base]] = p[~is_base]
    low, high = of["low"][0].as_py(), of["high"][0].as_py()
    a_of, b_of, d_of = [], [], []
    for a in np.flatnonzero(of_block == low):
        b = np.flatnonzero((of_block == high) & (np.arange(len(sources)) != a))
        d = np.abs(dense[:, b] - dense[:, [a]]).sum(0) - len(ids) * np.abs(base[b] - base[a])
        b, d = b[d != 0], d[d != 0]
        a_of.append(np.full(len(b), a))
        b_of.append(b)
        d_of.append(d)
    a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_of, b_of, d_of))
    if low != high:
        a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    lang = of["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(sources[a].tolist(), pa.string()), "item": pa.array(sources[b].tolist(), pa.string()), "d": pa.array(d, pa.int64())})


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM grid JOIN v USING (lang)),
of_lang AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM of_lang JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""
