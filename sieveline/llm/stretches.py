"""Stretches of bytes: hashes of many at once, equal ones by content, and a memory of those met before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Stretches of more bytes are hashed one by one.
SHORT = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED = np.uint64(0x2545F4914F6CDD1D)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as one number, zeros beyond its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each data[start:end]: eight bytes at a time are mixed in, so that no algebra of the bytes makes two collide."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) ^ _SEED)
    lanes = _lanes(data)
    rows = np.flatnonzero((size > 0) & (size <= SHORT))
    at, left, h = start[rows], size[rows], out[rows]
    while len(rows):
        h = mix(h ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
        over = left > 8
        out[rows[~over]] = h[~over]
        rows, at, left, h = rows[over], at[over] + 8, left[over] - 8, h[over]
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each data[start:end], (data, offsets) of the contents by code). Stretches are in order and do not overlap; the same contents have one code."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    # Stretches and the gaps between them alternate: one Arrow array on the data as it is.
    edges = np.stack([start, end], axis=1).ravel().astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    # Codes of gaps are left out.
    codes, present = coded.indices.to_numpy()[::2], np.zeros(len(coded.dictionary), bool)
    present[codes] = True
    kept = coded.dictionary.filter(pa.array(present))
    _, offsets, content = kept.buffers()
    offsets = np.frombuffer(offsets, np.int64)[kept.offset : kept.offset + len(kept) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    return (np.cumsum(present) - 1)[codes], content[: offsets[-1]], offsets


class Memory:
    """Rows of distinct stretches in order of arrival. They are looked up by 64 bits and compared by content, so a row is never another stretch's."""

    def __init__(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.data, self.used, self.at = np.zeros(1 << 16, np.uint8), 0, np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def apart(self) -> int:
        """A further row that no stretch is found under."""
        self.at = np.append(self.at, self.used)
        return len(self) - 1

    def _same(self, rows: np.ndarray, content: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        own, size = self.at[rows], end - start
        same = self.at[rows + 1] - own == size
        here, there = _lanes(content), np.ndarray((self.used + 1,), "<u8", self.data, strides=(1,))
        left = np.flatnonzero(same & (size > 0))
        at = 0
        while len(left):
            mask = _MASK[np.minimum(size[left] - at, 8)]
            equal = (here[start[left] + at] & mask) == (there[own[left] + at] & mask)
            same[left[~equal]] = False
            at += 8
            left = left[equal & (size[left] > at)]
            if at >= SHORT:
                for k in left.tolist():
                    same[k] = bool((content[start[k] : end[k]] == self.data[own[k] : own[k] + size[k]]).all())
                break
        return same

    def __call__(self, content: np.ndarray, offsets: np.ndarray, salt: int | np.ndarray = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row of each of the distinct stretches content[offsets[i]:offsets[i+1]], those that are new, in order of their rows). salt: equal contents with other numbers are other stretches.

        A stretch whose 64 bits another one holds gets row -1.
        """
        start, end = offsets[:-1], offsets[1:]
        keys = mix(hashes(content, start, end) + np.asarray(salt, np.uint64))
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = np.flatnonzero(place < len(self.keys))
        known[inside] = self.keys[place[inside]] == keys[inside]
        rows = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(known)
        rows[hit] = self.row[place[hit]]
        rows[hit[~self._same(rows[hit], content, start[hit], end[hit])]] = -1
        new = np.flatnonzero(~known)
        new = np.sort(new[np.unique(keys[new], return_index=True)[1]])
        if len(new):
            rows[new] = len(self) + np.arange(len(new))
            size = (end - start)[new]
            while self.used + int(size.sum()) + 8 > len(self.data):
                self.data = np.concatenate([self.data, np.zeros_like(self.data)])
            upto = np.cumsum(size)
            self.data[self.used : self.used + int(upto[-1])] = content[np.repeat(start[new] - (upto - size), size) + np.arange(int(upto[-1]))]
            self.at = np.concatenate([self.at, self.used + upto])
            self.used += int(upto[-1])
            order = new[np.argsort(keys[new], kind="stable")]
            put = np.searchsorted(self.keys, keys[order])
            self.row = np.insert(self.row, put, rows[order].astype(np.int32))
            self.keys = np.insert(self.keys, put, keys[order])
        return rows, new
