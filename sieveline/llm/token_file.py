"""Operator 5: token ids in frequency-ranked, byte-aligned variable-length blocks.

Documents are range-partitioned by doc_id, sorted, and encoded; each task cuts its stream of ids into
blocks and writes them through Spark's committer, so a lost task's blocks are written anew or not at all.
A block holds whole documents (a longer one is a block of its own):

    doc_ids   int64 each (null: the smallest long)      counts    uint32 each: ids of the document
    ranks     uint32 each: id of every rank, the block's most frequent id first (ties: smaller id)
    control   2 bits per id, 4 ids a byte, low bits first: bytes of its rank less 1
    data      the ranks, little-endian, 1 to 4 bytes each

Frequent ids so take one byte. Decoding looks the control bytes up in a table and gathers with numpy.

Defined results: null text counts as empty and has only the end id; rows are in order of (doc_id, hash
of text), null doc_id first; rows that repeat a doc_id are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.batches import KEPT
from sieveline.llm.common import chunks, ints, mapped, staged, text_buffers
from sieveline.llm.stretches import Memory, distinct

END_ID = 2
BLOCK_IDS = 1 << 19
#: Bytes of text that are encoded at a time.
ENCODED_BYTES = 1 << 20
#: Stretches whose ids a Python worker remembers before it forgets the rare ones.
REMEMBERED = 500_000
BLOCKS = "part int, block int, first_id long, n_docs long, n_ids long, doc_ids binary, counts binary, ranks binary, control binary, data binary"
#: Stretches that are encoded as one line; the library takes longer over long lines.
LINE = 128
#: Bytes that are white space, that begin a longer sign of it, and that end one.
_SPACE, _OPENS, _CLOSES = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\v\f\r\x1c\x1d\x1e\x1f ", b"\xc2\xe1\xe2\xe3", bytes({chr(c).encode()[-1] for c in range(128, 0x3001) if chr(c).isspace()})))
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_ENCODERS: dict[str, Encoder] = {}
KEPT[__name__] = _ENCODERS.clear


def _bare(contents: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether contents[start:end] is not empty and has no white space at its ends."""
    bare = end > start
    rows = np.flatnonzero(bare)
    first, last = contents[start[rows]], contents[end[rows] - 1]
    bare[rows[_SPACE[first] | _SPACE[last]]] = False
    for k in rows[_OPENS[first] | _CLOSES[last]].tolist():
        text = contents[start[k] : end[k]].tobytes().decode("utf-8", "surrogatepass")
        bare[k] = not text[0].isspace() and not text[-1].isspace()
    return bare


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library; equal stretches of text are encoded once.

    A space between two other signs always starts a piece of the pre-tokenizer, and BPE never merges across
    pieces. So texts are cut at spaces, and the ids of each stretch are remembered (and found by its content). Texts
    with further white space next to a space, or with one of the file's special strings, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        # What is encoded is new: the library's own memory of pieces would only cost.
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.wide = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.memory, self.start, self.length = Memory(), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.wide), 0
        # Of each remembered stretch: whether it is a text's head, and in how many calls it was met.
        self.head, self.met = np.zeros(0, bool), np.zeros(0, np.int32)

    def _forget_rare(self) -> None:
        """Only stretches that were met in several calls stay, unless they are more than half of REMEMBERED; they have to be met again to stay longer."""
        old, rows = (self.memory, self.start, self.length, self.flat, self.head), np.flatnonzero(self.met > 1)
        self._forget()
        if not 0 < len(rows) <= REMEMBERED // 2:
            return
        memory, start, length, flat, head = old
        gathered = lambda data, at, size: (data[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())], np.concatenate([[0], np.cumsum(size)]))
        self.memory(*gathered(memory.data, memory.at[rows], memory.at[rows + 1] - memory.at[rows]), head[rows])
        self.length, self.head, self.met = length[rows], head[rows], np.ones(len(rows), np.int32)
        ids, at = gathered(flat, start[rows], np.maximum(self.length, 0).astype(np.int64))
        self.flat, self.used, self.start = np.concatenate([ids, np.zeros(1 << 16, self.wide)]), len(ids), at[:-1]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, contents: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> None:
        """Remember the ids of further stretches contents[start:end], with a space before those that are not a text's head; length -1 where white space is at an end."""
        fit = _bare(contents, start, end)
        begins, length = np.zeros(len(start), np.int64), np.where(fit, 0, -1).astype(np.int32)
        inner, first = np.flatnonzero(fit & ~heads), np.flatnonzero(fit & heads)
        # A space, then the stretch, one after another: lines of LINE stretches are encoded in one go, and the ids that begin with a space tell them apart.
        size = end[inner] - start[inner] + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        spaced = np.full(upto[-1], 32, np.uint8)
        behind = np.ones(upto[-1], bool)
        behind[upto[:-1]] = False
        spaced[behind] = contents[np.repeat(start[inner] - upto[:-1] - 1, size)[behind] + np.flatnonzero(behind)]
        text, flat, used = spaced.tobytes(), [], self.used
        own = lambda k: contents[start[k] : end[k]].tobytes().decode("utf-8", "surrogatepass")
        for a in range(0, len(inner), LINE):
            part = inner[a : a + LINE]
            line = np.array(self.library.encode_batch_fast([text[upto[a] : upto[a + len(part)]].decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, self.wide)
            at = np.flatnonzero(self.spaced[line])
            if len(at) != len(part) or at[0] != 0:
                cut = [e.ids for e in self.library.encode_batch_fast([" " + own(k) for k in part.tolist()], add_special_tokens=False)]
                at, line = np.cumsum([0, *map(len, cut[:-1])]), np.array([i for x in cut for i in x], self.wide)
            begins[part], length[part] = used + at, np.diff(at, append=len(line))
            flat.append(line)
            used += len(line)
        for k, e in zip(first.tolist(), self.library.encode_batch_fast([own(k) for k in first.tolist()], add_special_tokens=False)):
            begins[k], length[k] = used, len(e.ids)
            flat.append(np.array(e.ids, self.wide))
            used += length[k]
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = np.concatenate([*flat, np.zeros(0, self.wide)])
        self.used = int(used)
        self.start, self.length = np.concatenate([self.start, begins]), np.concatenate([self.length, length])
        self.head, self.met = np.concatenate([self.head, heads]), np.concatenate([self.met, np.zeros(len(heads), np.int32)])

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text raw[offsets[i]:offsets[i+1]]."""
        if len(self.memory) > REMEMBERED:
            self._forget_rare()
        low = int(offsets[0])
        data, at = raw[low : int(offsets[-1])], offsets - low
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(at) - 1)
        content = data.tobytes()
        full = np.flatnonzero(np.diff(at))
        space = np.flatnonzero(data == 32)
        starts = np.sort(np.concatenate([at[full], space + 1]))
        ends = np.sort(np.concatenate([space, at[full + 1]]))
        n_of = np.diff(np.searchsorted(space, at)) + (np.diff(at) > 0)
        first = np.cumsum(n_of) - n_of
        head = np.zeros(len(starts), bool)
        head[first[full]] = True
        codes, contents, of = distinct(data, starts, ends)
        # A text's head has no space before it: it is another stretch than the same signs elsewhere.
        codes = 2 * codes + head
        present = np.zeros(2 * len(of), bool)
        present[codes] = True
        codes, inverse = np.flatnonzero(present), (np.cumsum(present) - 1)[codes]
        size = np.diff(of)[codes >> 1]
        upto = np.cumsum(size)
        contents = contents[np.repeat(of[codes >> 1] - (upto - size), size) + np.arange(upto[-1])]
        of, heads = np.concatenate([[0], upto]), codes & 1
        row, new = self.memory(contents, of, heads)
        if len(new):
            self._learn(contents, of[new], of[new + 1], heads[new].astype(bool))
        self.met[row[row >= 0]] += 1
        # Texts with a stretch that cannot be remembered are encoded whole.
        length, begins = np.where(row < 0, -1, self.length[row])[inverse], self.start[row][inverse]
        torn = np.zeros(len(n_of), bool)
        torn[np.repeat(np.arange(len(n_of)), n_of)[length < 0]] = True
        for special in self.special:
            if special in content:
                torn |= [special in content[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        # All ids at once: each stretch's run of the remembered ids, one after another.
        size = np.maximum(length, 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begins - upto[:-1], size) + np.arange(upto[-1])].astype(np.uint32)
        begin, end = upto[first], upto[first + n_of]
        return [self.whole(content[a:b].decode("utf-8", "surrogatepass")) if t else ids[x:y] for t, x, y, a, b in zip(torn.tolist(), begin.tolist(), end.tolist(), at[:-1].tolist(), at[1:].tolist())]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks, control, data) of ids."""
    if len(ids) and ids.max() < 1 << 20:
        n = np.bincount(ids)
        values = np.flatnonzero(n)
        n, place = n[values], ids
    else:
        values, place, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -n))
    rank_of = np.empty(int(values.max(initial=0)) + 1 if place is ids else len(values), np.uint32)
    rank_of[values[order] if place is ids else order] = np.arange(len(values), dtype=np.uint32)
    ranked = rank_of[place]
    size = 1 + (ranked > 0xFF) + (ranked > 0xFFFF) + (ranked > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = ranked[has] >> np.uint32(8 * k) & np.uint32(0xFF)
    return values[order].astype(np.uint32), control, data


def unpack(ranks: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    size = _LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    ranked = padded[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        ranked[has] |= padded[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks[ranked]


def _blocks(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        docs, held, size, block, first = [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ranks, control, data = pack(ids)
            cells = [np.array(docs, np.int64), np.array([len(x) for x in held], np.uint32), ranks, control, data]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([len(docs)]), pa.array([len(ids)]), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                [f.split()[0] for f in BLOCKS.split(", ")],
            )

        for batch in batches:
            doc = ints(batch.column(0))
            raw, at = text_buffers(batch.column(1))
            for a, b in chunks(at, ENCODED_BYTES):
                for i, ids in zip(doc[a:b].tolist(), encode(raw, at[a : b + 1])):
                    if held and size + len(ids) + 1 > BLOCK_IDS:
                        yield cut()
                        block, first, docs, held, size = block + 1, first + size, [], [], 0
                    docs.append(i)
                    held.append(np.append(ids, np.uint32(END_ID)))
                    size += len(ids) + 1
        if held:
            yield cut()

    return write


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
            docs = np.frombuffer(row["doc_ids"], np.int64)
            raw = {k: np.frombuffer(row[k], np.uint8) for k in ("control", "data")}
            ids = unpack(np.frombuffer(row["ranks"], np.uint32), raw["control"], raw["data"], row["n_ids"]).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist())]
            same = lambda x: pa.array([x] * len(docs), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=docs == -(2**63)), same(row["part"]), pa.array(row["first_id"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "part", "at", "n_tokens", "ids_crc32"],
            )


def written(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The table of blocks that encodes documents, written in the shared folder and read again."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return staged(mapped(ranged, _blocks(tokenizer), BLOCKS), "token-blocks")


def index(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from blocks."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each part, of which there are no more than shuffle partitions.
    starts = F.broadcast(parts.select("part", F.coalesce(before, F.lit(0)).alias("base")))
    read = blocks.select("part", "first_id", "n_ids", "doc_ids", "counts", "ranks", "control", "data")
    docs = mapped(read, _decoded, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_index(documents: DataFrame, tokenizer: str) -> DataFrame:
    return index(written(documents, tokenizer))
