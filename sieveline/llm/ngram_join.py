"""Operator 3: exact Jaccard self-join of word 5-gram sets by adaptive multi-match prefixes.

Two documents link when 100 * |A & B| >= 80 * |A | B|. Shingles are ordered rarest first by hashed
corpus counts (ties by hash: any one order gives the same links). With n shingles and p = n - ceil(0.8 n),
two linked documents share at least l of their first p + l shingles, for every l. A document lengthens
its prefix (l = 1..4) where hashed counts say that its first one would meet many documents; a pair is
verified only when it shares as many prefix shingles as the smaller l of the two asks for.

Groups of near copies are not expanded into pairs. Documents with one and the same set are folded
first. Then each shared prefix shingle's most central document is verified against the others (a
star, linear in the group), and only pairs that are still in different components are compared, when no shingle
meets more than PAIRED of them or CROWDED rounds are over.

A shingle may be in a third of all documents. Those that the hashed counts show as HOT are therefore
aggregated before they are shuffled; the others, whose groups are bounded by that, meet in a window. What follows works on
shared shingles alone, as aggregations joined back to the rows, of which Spark splits skewed partitions.
Sets and bit maps are computed once a round, for the documents of its pairs.

Defined results: null and empty texts have 0 shingles and link with nothing; a null doc_id is never
linked and has a null component; rows that repeat a doc_id come back once each with their own size and
one component: the row with the most shingles stands for them. An empty table gives an empty result; texts of any
length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import sketch
from sieveline.llm.common import BROADCAST_IDS, chunks, discard, ints, keep_ids, mapped, staged, text_buffers
from sieveline.llm.components import components
from sieveline.llm.shingles import shingle_sets
from sieveline.llm.stretches import mix

#: Longest extension of a prefix: at most so many shared prefix shingles are asked for.
MOST = 4
#: Cost of verifying a candidate, counted in prefix entries read.
VERIFY = 16.0
#: Rounds of stars before the remaining pairs across components are compared; as many as CROWDED while a shingle meets over PAIRED of them.
STARS, CROWDED, PAIRED = 2, 6, 500
#: A shingle is hot whose hashed count, beyond chance collisions, is over this.
HOT = 1000.0
#: Bits of the map of a set that rules most pairs out before whole sets are moved.
MAP_BITS = 8192


def _needed(n):
    """Least overlap with any partner: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of a batch with the text in column 1, in bounded pieces."""
    raw, at = text_buffers(batch.column(1))
    for a, b in chunks(at):
        yield a, shingle_sets(raw, at[a : b + 1])


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, sets in _sets(batch):
        yield np.concatenate(sets)


def _classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters as half-octave classes of one byte, and the documents that a shingle of each class is expected to meet beyond chance collisions."""
    noise = counts.mean() + 3 * np.sqrt(counts.mean())
    classes = np.rint(2 * np.log2(1 + counts)).astype(np.uint8)
    return classes, np.maximum(0, 2 ** (np.arange(256) / 2) - 1 - noise)


def _level(meets: np.ndarray, n: int) -> int:
    """The l whose prefix costs least: entries read, plus candidates, of which each is met l times or more."""
    first = n - _needed(n) + 1
    longest = min(MOST, n - first + 1)
    seen = np.cumsum(meets)[first - 1 : first - 1 + longest]
    more = np.arange(1, longest + 1)
    return int(np.argmin(more + seen * (1 + VERIFY / more))) + 1


def _key(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two columns."""
    key = np.array([(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(17)))) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return key[:, 0].copy(), key[:, 1].copy()


def _prefixes(classes: np.ndarray, meets: np.ndarray):
    """Mapper: each document's set size, 128-bit key of its set, l and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ints(batch.column(0))
            for first, sets in _sets(batch):
                n = np.array([len(s) for s in sets], np.int64)
                level, prefix, cold = [], [], []
                for s in sets:
                    if not len(s):
                        level.append(0)
                        prefix.append(s)
                        cold.append(0)
                        continue
                    of = classes[sketch.slots(s)]
                    order = np.argsort(of, kind="stable")  # the set itself is in order of hash
                    x = _level(meets[of[order]], len(s))
                    level.append(x)
                    prefix.append(s[order[: len(s) - _needed(len(s)) + x]])
                    # In order of counts, the hot ones are last.
                    cold.append(int(np.count_nonzero(meets[of[order[: len(prefix[-1])]]] <= HOT)))
                ends = np.cumsum([0] + [len(p) for p in prefix])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
                doc = ids[first : first + len(sets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == -(2**63)), pa.array(n), *map(pa.array, _key(sets)), pa.array(level, pa.int32()), pa.array(cold, pa.int32()), tokens],
                    ["doc_id", "n", "key_a", "key_b", "l", "cold", "tokens"],
                )

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: each document's whole set, a bit map of it, and how many shingles are over the set bits."""
    for batch in batches:
        ids = ints(batch.column(0))
        for first, sets in _sets(batch):
            maps, over = np.zeros((len(sets), MAP_BITS // 8), np.uint8), []
            for k, s in enumerate(sets):
                bits = np.zeros(MAP_BITS, np.uint8)
                bits[(s & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
                maps[k] = np.packbits(bits)
                over.append(len(s) - int(bits.sum()))
            listed = lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            bits, whole = listed(maps.view(np.int64).ravel(), np.arange(len(sets) + 1) * (MAP_BITS // 64)), listed(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(sets)]), *map(pa.array, _key(sets)), bits, pa.array(over, pa.int64()), whole], ["doc_id", "key_a", "key_b", "bits", "over", "set"])


def _verified(pairs: DataFrame, texts: DataFrame, spare: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb), those that link.

    Sets and bit maps of their documents are staged. Bit maps rule most pairs out: common shingles are no more than common
    bits and the shingles that share a bit. Of the others, b's set goes to where a's is, once for each pair. The
    short rows of pairs and ids are broadcast while they are few.
    """
    docs = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    found = mapped(keep_ids(texts, docs, "doc_id", rows=2 * pairs.count()), _whole, "doc_id long, key_a long, key_b long, bits array<long>, over long, set array<long>")
    own = staged(keep_ids(found, spare, ["doc_id", "key_a"], "left_anti").select("doc_id", "bits", "over", "set"), "sets")
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("over").alias(f"over_{x}"))
    common = "aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x & y)), 0, (n, x) -> n + x) + least(over_a, over_b)"
    possible = staged(pairs.join(side("a"), "a").join(side("b"), "b").filter(f"9 * ({common}) >= 4 * (na + nb)").select("a", "b", "na", "nb"))
    n = possible.count()
    sets = lambda of: own.select("doc_id", "set").join(F.broadcast(of) if n <= BROADCAST_IDS else of, "doc_id")
    left = sets(possible.select(F.col("a").alias("doc_id")).distinct()).select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = sets(possible.withColumnRenamed("b", "doc_id")).select("a", F.col("doc_id").alias("b"), "na", "nb", F.col("set").alias("set_b"))
    held = right.join(left, "a").filter("9 * size(array_intersect(set_a, set_b)) >= 4 * (na + nb)")
    linked = staged(held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    discard(own, possible, pairs)
    return linked


#: Of rows x and y on one shared prefix shingle: their sizes allow a link, and so do the shingles around
#: it. Before it, only prefix shingles that some other document shares (r of them) can be common. A pair is
#: counted on its first l common shingles alone, so for counting less than l of them lie before.
_FEASIBLE = """5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  and 9 * (least(x.r, y.r{counted}) + 1 + least(x.n - x.pos - 1, y.n - y.pos - 1)) >= 4 * (x.n + y.n)"""
_STAR, _COUNTED = _FEASIBLE.format(counted=""), _FEASIBLE.format(counted=", least(x.l, y.l) - 1")


def links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): rows doc_id, n, rep for every row of documents, rep being the least doc_id with the same set; edges a < b between linked reps that join all components."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, meets = _classes(sketch.counted(texts, _hashes))
    schema = "doc_id long, n long, key_a long, key_b long, l int, cold int, tokens array<long>"
    rows = staged(mapped(texts, _prefixes(classes, meets), schema), "prefixes")
    same = ["n", "key_a", "key_b"]
    keyed = rows.select("doc_id", *same).filter("n > 0 and doc_id is not null").distinct()
    chosen = keyed.groupBy("doc_id").agg(F.max(F.struct(*same)).alias("k")).select("doc_id", "k.*")
    reps = staged(chosen.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    named = rows.select("doc_id", "n").join(chosen.join(reps, same).select("doc_id", "rep"), "doc_id", "left")

    spare = staged(keyed.join(reps.select(*same, F.col("rep").alias("doc_id")), ["doc_id", *same], "left_anti").select("doc_id", "key_a"))
    unique = keep_ids(rows.filter("n > 0 and doc_id is not null"), spare, ["doc_id", "key_a"], "left_anti")
    entries = unique.select(F.col("doc_id").alias("doc"), "n", "l", "cold", F.posexplode("tokens").alias("pos", "token"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    shared = _shared(entries).repartition("doc").dropDuplicates(["doc", "token"])
    ranked = shared.withColumn("r", rank).withColumn("level", F.expr("greatest(1, pos + 1 - (n - (4 * n + 4) div 5))"))
    open_rows = staged(ranked.withColumns({"comp": F.col("doc"), "tried": F.lit(False)}))
    edges = texts.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for k in range(CROWDED):
        if k >= STARS and not open_rows.groupBy("token").agg(F.count_distinct("comp").alias("n")).filter(F.col("n") > PAIRED).limit(1).count():
            break
        # The centre has the fewest prefix shingles of its own, among components that had no centre at this shingle.
        central = F.struct((~F.col("tried")).alias("new"), (-(F.col("pos") - F.col("r")) / F.col("n")).alias("c"), (-F.col("doc")).alias("d"))
        centres = staged(open_rows.groupBy("token").agg(F.max_by(F.struct("doc", "n", "pos", "r", "comp", "tried"), central).alias("y")).filter("not y.tried"))
        star = open_rows.join(centres, "token").select("y", F.struct("doc", "n", "pos", "r", "comp").alias("x")).filter("x.doc <> y.doc and x.comp <> y.comp").filter(_STAR)
        pairs = staged(star.select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb")).distinct())
        if pairs.isEmpty():
            break
        edges = edges.union(_verified(pairs, texts, spare))
        before, open_rows = open_rows, _still_open(open_rows, centres, edges)
        discard(before, centres)
    x, y = open_rows.alias("x"), open_rows.alias("y")
    cross = x.join(y, "token").filter("x.doc < y.doc and x.comp <> y.comp and greatest(x.level, y.level) <= least(x.l, y.l)").filter(_COUNTED)
    cross = cross.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.first("x.n").alias("na"), F.first("y.n").alias("nb"), F.first(F.least("x.l", "y.l")).alias("asked"), F.count("*").alias("met"))
    pairs = staged(cross.filter("met >= asked").drop("asked", "met"))
    if not pairs.isEmpty():
        edges = edges.union(_verified(pairs, texts, spare))
    discard(open_rows)
    return named, edges


def _shared(entries: DataFrame) -> DataFrame:
    """The entries on shingles that several documents have in their prefixes."""
    cold, hot = entries.filter("pos < cold").drop("cold"), entries.filter("pos >= cold").drop("cold")
    of = Window.partitionBy("token")
    cold = cold.withColumns({"low": F.min("doc").over(of), "high": F.max("doc").over(of)}).filter("low < high").drop("low", "high")
    met = hot.groupBy("token").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("token")
    return cold.union(keep_ids(hot, staged(met), "token").select(cold.columns))


def _still_open(rows: DataFrame, centres: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with their new components, those of centres marked as tried, on shingles that still meet several components."""
    placed = staged(components(edges).withColumnRenamed("node", "doc"))
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_IDS else placed
    now = rows.drop("comp").join(placed, "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
    own = centres.select("token", F.col("y.doc").alias("doc")).join(placed, "doc", "left").select("token", F.coalesce("root", "doc").alias("own"))
    # A written table, so that the join below has nothing but shuffles under it, whose skewed partitions Spark splits.
    several = staged(now.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("token").join(own, "token", "left"))
    left = now.join(several, "token").withColumn("tried", F.col("tried") | F.coalesce(F.col("comp") == F.col("own"), F.lit(False))).drop("own")
    return staged(left.select(rows.columns))


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)."""
    rows, edges = links(documents)
    of = components(edges)
    out = rows.join(of, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents without near copies: of each group the rows with the least doc_id stay, and rows without an id."""
    groups = near_groups(documents).select("doc_id", "component_id").distinct()
    gone = staged(groups.filter("doc_id > component_id").select("doc_id").distinct())
    return keep_ids(documents, gone, "doc_id", "left_anti").select(*documents.columns)
