"""Texts joined with a table of fragments: an Aho-Corasick automaton instead of a condition for each pair.

Matches are those of an alternation of the fragments in their order, found from the left: at each place the first fragment in order that
fits counts, and the search goes on behind it. The table is put in order and cut into slices of at most SLICE_BYTES, each sent to the workers once, so memory does not follow
the table; a text passes the slices' automata one after the other, in one stage, without a shuffle, and the last step settles overlaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of fragments in an automaton (an automaton takes some 60 times as much).
SLICE_BYTES = 4 << 20
#: Bytes and fragments of a whole table that go through the driver, checked before any is fetched.
MOST_BYTES, MOST_ROWS = 64 << 20, 2_000_000
FOUND = "array<struct<start:int,place:int,length:int>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("length", pa.int32())]))


@dataclass
class Fragments:
    """A table of fragments, ready to be matched: its slices as broadcasts, and the version of what they hold."""

    slices: list
    table: DataFrame
    version: str


def fragment_list(fragments: DataFrame, column: str, order: list[str], slice_bytes: int = SLICE_BYTES) -> Fragments:
    """fragments in `order` (which should tell them apart; ties go by themselves). Null and empty fragments are left out, of repeated ones the first counts."""
    spark = fragments.sparkSession
    usable = fragments.filter(F.length(column) > 0).select(F.col(column).alias("fragment"), F.struct(*order, F.col(column).alias("_own")).alias("at"))
    usable = usable.groupBy("fragment").agg(F.min("at").alias("at"))
    rows, size = usable.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("fragment")), F.lit(0))).first()
    if rows > MOST_ROWS or size > MOST_BYTES:
        raise ValueError(f"{rows} fragments of {size} bytes: more than {MOST_ROWS} or {MOST_BYTES}; match them in parts")
    digest, slices, held, held_bytes, listed = hashlib.sha256(), [], [], 0, []
    for place, row in enumerate(usable.orderBy("at").select("fragment").toLocalIterator(prefetchPartitions=True)):
        raw = row.fragment.encode("utf-8", "surrogatepass")
        digest.update(len(raw).to_bytes(8, "big") + raw)
        held.append((row.fragment, place))
        listed.append((place, row.fragment))
        held_bytes += len(raw)
        if held_bytes >= slice_bytes:
            slices.append(spark.sparkContext.broadcast(held))
            held, held_bytes = [], 0
    if held or not slices:
        slices.append(spark.sparkContext.broadcast(held))
    return Fragments(slices, spark.createDataFrame(listed, "place int, fragment string"), digest.hexdigest())


#: A worker's automata by list version and slice; those of another version go.
_BUILT: dict = {}


def _automaton(version: str, k: int, shared):
    import ahocorasick

    if _BUILT.get("version") != version:
        _BUILT.clear()
        _BUILT["version"] = version
    if k not in _BUILT:
        built = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for fragment, place in shared.value:
            built.add_word(fragment, (place, len(fragment)))
        if len(built):
            built.make_automaton()
        _BUILT[k] = built
    return _BUILT[k]


def leftmost(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of all (start, place, length): from the left the first in place at each start, none that overlaps one before."""
    out, free = [], 0
    for hit in sorted(hits):
        if hit[0] >= free:
            out.append(hit)
            free = hit[0] + hit[2]
    return out


def fragments_in(rows: DataFrame, text: str, fragments: Fragments, column: str = "found") -> DataFrame:
    """rows with `column`: the matches in text, in order: start (code points from 0), place (of fragments.table) and length.

    Null and empty texts have none. Letters are compared as they are: fold both sides first where case does not count. Columns of rows keep their names.
    """
    last = len(fragments.slices) - 1
    of = rows.drop(column).withColumn(column, F.array().cast(FOUND))
    for k, shared in enumerate(fragments.slices):
        of = of.mapInArrow(_searching(fragments.version, k, shared, of.columns.index(text), k == last), of.schema)
    return of


def _searching(version: str, k: int, shared, text: int, last: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(version, k, shared)
        for batch in batches:
            found = []
            for value, before in zip(batch.column(text), batch.column(batch.num_columns - 1).to_pylist()):
                hits = [(h["start"], h["place"], h["length"]) for h in before]
                value = value.as_py()
                if value and len(automaton):
                    hits += [(end - n + 1, place, n) for end, (place, n) in automaton.iter(value)]
                found.append([dict(zip(("start", "place", "length"), h)) for h in (leftmost(hits) if last else hits)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _HITS)], schema=pa.schema([*[batch.schema.field(j) for j in range(batch.num_columns - 1)], pa.field(batch.schema.names[-1], _HITS)]))

    return search
