"""Operator 12: the prefix trie of conversations, by distributed MSD radix partitioning.

Turns (role, text) are encoded as numbers of a dictionary; a conversation is then a short array. Conversations are dealt out by
their turns from the first on, as an MSD radix sort deals strings by characters: a bucket is the conversations that share a prefix. A bucket of
more than LOCAL conversations is counted where its rows lie (rows are aggregated before they are shuffled, no row moves), skips
at once the prefix that its smallest and largest member share, and is dealt on by its next turn. Smaller buckets go whole to a task, many to
each, where multikey quicksort finishes them one at a time; nodes are emitted as the recursion meets them. So a bucket that a third of all
conversations share never meets in one task, and rounds follow the branches of such buckets, not the turns.

The nodes of a large bucket's common prefix are a chain with the same members: they come from one row, with their subtrees' sums added up over the
buckets below. The ids that end at such a node are joined in ranges of CHUNK ids, and the digest runs over these pieces in order, holding one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_IDS, bounded, mapped, staged

#: Conversations that one call of multikey quicksort finishes at most.
LOCAL = 250
#: Turns that more than 1/HOT of all rows say are looked up in a broadcast table (of fewer than HOT rows).
HOT = 1000
#: Ids in a piece of a digest's input, and nodes in an Arrow batch.
CHUNK, NODES = 10_000, 10_000
#: Every conversation starts with the first turns, LONGEST at most, of the conversation at the head of its block of BLOCK ids.
BLOCK, LONGEST = 20, 3
NONE = hashlib.sha256(b"").hexdigest()

MEMBERS = "conv_id long, ids array<long>, words array<long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- Turns as numbers -------------------------------------------------------------------------------


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: a row a conversation, its turns as dictionary numbers in order, and the words of each.

    Texts are shuffled once, for the order of turns, and are hashes (128 bits) from then on. The dictionary's numbers are unique, not dense.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = said.select("conv_id", F.row_number().over(order).alias("at"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"), words.alias("words"))
    turns = staged(turns, "turns")
    counts = turns.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    dictionary = staged(counts.select("h1", "h2", "n", F.monotonically_increasing_id().alias("id")), "dictionary")
    hot = dictionary.filter(F.col("n") > max(HOT, turns.count() // HOT)).select("h1", "h2", F.col("id").alias("hot_id"))
    met = turns.join(F.broadcast(hot), ["h1", "h2"], "left")
    often = met.filter("hot_id IS NOT NULL").select("conv_id", "at", F.col("hot_id").alias("id"), "words")
    rest = met.filter("hot_id IS NULL").join(dictionary.select("h1", "h2", "id"), ["h1", "h2"]).select("conv_id", "at", "id", "words")
    gathered = often.union(rest).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", "words"))).alias("s"))
    return gathered.select("conv_id", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform("s", lambda x: x["words"]).alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations c with their first h = crc32(c) % 4 turns taken from conversation c - c % 20 (all if it has fewer, none without it)."""
    own = staged(own, "conversations")
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("head"), F.slice("ids", 1, LONGEST).alias("head_ids"), F.slice("words", 1, LONGEST).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST + 1)).cast("int")
    met = own.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % BLOCK}).join(heads, F.col("of") == F.col("head"), "left")

    def built(head: str, rest: str):
        first = F.slice(F.coalesce(head, F.array().cast("array<long>")), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest), F.lit(1)))).alias(rest)

    return met.select("conv_id", built("head_ids", "ids"), built("head_words", "words"))


# --- Buckets of any size ----------------------------------------------------------------------------


def _common(a, b):
    """How many elements two arrays share at their start."""
    most = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
    return F.when(most == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, most)).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def trie(members: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of members (conv_id, ids, words; conv_id is unique), as NODE says.

    A node is a distinct prefix; its conv_id is the smallest member's, so (depth, conv_id) names it.
    """
    least = members.agg(F.min("conv_id")).first()[0]
    if least is None:
        return members.sparkSession.createDataFrame([], NODE)
    # A bucket is named by the node at which it begins: its depth s and its smallest conv_id c. All is one bucket at first. It is staged with its
    # name: as a constant, joins on it would become nested loops.
    name = F.struct(F.lit(0).cast("long").alias("s"), F.lit(least).cast("long").alias("c"))
    open_ = staged(members.select("*", name.alias("bucket")), "members")
    about = open_.limit(1).select("bucket", F.array("bucket").alias("path"), F.lit(None).cast("long").alias("parent"))
    rounds, seen = [], []
    while True:
        found = open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi"))
        end = _common(F.col("lo.ids"), F.col("hi"))
        buckets = staged(found.select("bucket", "n", end.alias("e"), F.slice("lo.words", F.lit(1), end).alias("words")).join(about, "bucket"), "buckets")
        rows = open_.join(_small(buckets.select("bucket", "e")), "bucket").withColumn("next", F.get("ids", F.col("e")))
        children = staged(rows.filter("next IS NOT NULL").groupBy("bucket", "e", "next").agg(F.count("*").alias("n"), F.min("conv_id").alias("c")), "children")
        large = children.filter(F.col("n") > local).select("bucket", "next", F.struct((F.col("e") + 1).cast("long").alias("s"), "c").alias("child"))
        dealt = staged(rows.join(_small(large), ["bucket", "next"], "left"), "dealt")
        rounds.append(buckets.join(children.groupBy("bucket").agg(F.count("*").alias("n_children")), "bucket", "left").fillna(0, ["n_children"]))
        seen.append(dealt)
        paths = buckets.select("bucket", "path").join(large, "bucket")
        about = staged(paths.select(F.col("child").alias("bucket"), F.concat("path", F.array("child")).alias("path"), F.col("bucket.c").alias("parent")), "paths")
        if not about.head(1):
            break
        open_ = dealt.filter("child IS NOT NULL").select("conv_id", "ids", "words", F.col("child").alias("bucket"))
    tops = reduce(DataFrame.unionByName, rounds)
    all_ = reduce(DataFrame.unionByName, seen)
    below = staged(_finished(all_.filter("next IS NOT NULL AND child IS NULL")), "nodes")
    return below.select(*[x.split()[0] for x in NODE.split(", ")]).unionByName(_chains(tops, below, _digests(all_.filter("next IS NULL").select("bucket", "conv_id"))))


def _chains(tops: DataFrame, below: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of large buckets: one for each depth from s to e, all with the bucket's members."""
    tops = staged(tops, "large")
    whole = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
    # Words of the bucket's own nodes are those from depth s on; the root has none.
    own_words = F.slice("words", F.greatest(F.col("bucket.s").cast("int"), F.lit(1)), F.greatest(F.size("words"), F.lit(1)))
    own = tops.select("bucket", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.aggregate(own_words, F.lit(0).cast("long"), lambda a, w: a + w)).alias("saved"))
    locals_ = below.filter(F.col("depth") == F.col("top")).groupBy("bucket").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    each = own.unionByName(locals_).join(_small(tops.select("bucket", "path")), "bucket")
    sums = each.select(F.explode("path").alias("bucket"), "leaves", "saved").groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rows = tops.join(sums, "bucket").join(ends, "bucket", "left").withColumn("depth", F.explode(F.sequence(F.col("bucket.s").cast("int"), F.col("e"))))
    at_end = F.col("depth") == F.col("e")
    # What the nodes above this one in the chain save: words of the depths from s to depth - 1.
    from_ = F.greatest(F.col("bucket.s").cast("int"), F.lit(1))
    above = F.aggregate(F.slice("words", from_, F.greatest(F.col("depth") - from_, F.lit(0))), F.lit(0).cast("long"), lambda a, w: a + w)
    return rows.select(
        F.col("bucket.c").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("bucket.s"), F.col("parent")).otherwise(F.col("bucket.c")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * above).alias("saved_tokens"), F.when(at_end, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
    )


# --- Buckets of at most LOCAL conversations ---------------------------------------------------------


def sorted_nodes(members: list[tuple[int, list[int], list[int]]], depth: int) -> list[list]:
    """Multikey quicksort of members (conv_id, ids, words), all with more than depth turns: [parent's place or -1, depth, conv_id, n_convs, words, ends, n_children, n_leaves, saved_tokens] of each node below depth."""
    nodes: list[list] = []
    stack = [(members, depth, -1)]
    while stack:
        rows, d, parent = stack.pop()
        while rows:
            pivot = rows[len(rows) // 2][1][d]
            less, same, more = [], [], []
            for r in rows:
                (same if r[1][d] == pivot else less if r[1][d] < pivot else more).append(r)
            ends = [r[0] for r in same if len(r[1]) == d + 1]
            nodes.append([parent, d + 1, min(r[0] for r in same), len(same), same[0][2][d], ends, 0, 0, 0])
            if len(ends) < len(same):
                stack.append(([r for r in same if len(r[1]) > d + 1], d + 1, len(nodes) - 1))
            if more:
                stack.append((more, d, parent))
            rows = less
    for node in reversed(nodes):  # children come after their parents
        node[7] += not node[6]
        node[8] += (node[3] - 1) * node[4]
        if node[0] >= 0:
            above = nodes[node[0]]
            above[6] += 1
            above[7] += node[7]
            above[8] += node[8]
    return nodes


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() if ids else NONE


def _finished(rows: DataFrame) -> DataFrame:
    """bucket, top and NODE's columns for rows (conv_id, ids, words, bucket, e, next): a small bucket is the rows of one next turn."""
    flat = rows.select(F.col("bucket.s").alias("s"), F.col("bucket.c").alias("c"), "e", "next", "conv_id", "ids", "words")
    together = flat.repartition("s", "c", "next").sortWithinPartitions("s", "c", "next")
    return mapped(together, _finish, f"s long, c long, top long, {NODE}").withColumn("bucket", F.struct("s", "c"))


_FINISHED = pa.schema([*[(x, pa.int64()) for x in ("s", "c", "top", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    key, e, members = None, 0, []

    def flush() -> None:
        if members:
            s, c = key[:2]
            nodes = sorted_nodes(members, e)
            for p, depth, conv, n, _, ends, children, leaves, saved in nodes:
                out.append((s, c, e + 1, conv, depth, nodes[p][2] if p >= 0 else c, n, children, leaves, saved, _digest(ends)))

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), _FINISHED.types)], schema=_FINISHED)

    for batch in batches:
        for s, c, depth, next_, conv, ids, words in zip(*[batch.column(k).to_pylist() for k in range(7)]):
            if (s, c, next_) != key:
                flush()
                if len(out) >= NODES:
                    yield table()
                    out.clear()
                key, e, members = (s, c, next_), depth, []
            members.append((conv, ids, words))
    flush()
    if out:
        yield table()


# --- Ids that end at a node of a large bucket -------------------------------------------------------


def _digests(ends: DataFrame) -> DataFrame:
    """bucket, ends_sha256 for rows (bucket, conv_id) of any number a bucket: ids are joined by ranges, and pieces digested in order."""
    bounded(ends.sparkSession)
    flat = ends.select(F.col("bucket.s").alias("s"), F.col("bucket.c").alias("c"), "conv_id")
    ranged = flat.repartitionByRange("s", "c", "conv_id").sortWithinPartitions("s", "c", "conv_id")
    pieces = mapped(ranged, _joined, "s long, c long, first long, piece string")
    ordered = pieces.repartition("s", "c").sortWithinPartitions("s", "c", "first")
    return mapped(ordered, _hashed, "s long, c long, ends_sha256 string").select(F.struct("s", "c").alias("bucket"), "ends_sha256")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"s": pa.array([key[0]], pa.int64()), "c": pa.array([key[1]], pa.int64()), "first": pa.array(held[:1], pa.int64()), "piece": [",".join(map(str, held))]})

    key, held = None, []
    for batch in batches:
        for s, c, conv in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if held and ((s, c) != key or len(held) == CHUNK):
                yield piece()
                held = []
            key = (s, c)
            held.append(conv)
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"s": pa.array([key[0]], pa.int64()), "c": pa.array([key[1]], pa.int64()), "ends_sha256": [digest.hexdigest()]})

    key, digest = None, None
    for batch in batches:
        for s, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (s, c) != key:
                if key is not None:
                    yield told()
                key, digest = (s, c), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.as_py().encode())
    if key is not None:
        yield told()


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Turns are in order of turn (null first), those that tie in order of role and text, repeated ones stay; null role and text are empty. Rows without
    a conv_id belong to no conversation and are left out. A conversation that keeps no turn is a member of the root and ends there. Texts of any length
    count whole; a conversation is one row of numbers, 16 bytes a turn. An empty table has no nodes; extra columns are ignored.
    """
    return trie(rebuilt(encoded(conversations)), local)


SQL = r"""
WITH rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns FROM rows GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(d.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM crc c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM built),
nodes AS (
  SELECT list_slice(turns, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
words AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes),
children AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT w.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children FROM words w LEFT JOIN nodes p ON w.depth > 0 AND p.prefix = list_slice(w.prefix, 1, w.depth - 1) LEFT JOIN children c ON c.prefix = w.prefix),
up AS (SELECT list_slice(prefix, 1, a) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256 FROM full_ f JOIN up u ON u.prefix = f.prefix
"""
