"""Hashed words and word shingles of UTF-8 text, computed with numpy on Arrow buffers.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word has 64 bits of its content, and a shingle's hash mixes
those of its words with a random odd number for each place.
"""

from __future__ import annotations

import numpy as np

from sieveline.llm.stretches import hashes, mix

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.random.default_rng(20240117).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of texts data[at[i]:at[i+1]]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:n]
    last = full.copy()
    last[:-1] &= ~full[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word) for texts raw[offsets[i]:offsets[i+1]]; the index has one entry more."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, at = _LOWER[raw[low:high]], offsets - low
    start, end = word_spans(data, at)
    return hashes(data, start, end), np.searchsorted(start, at)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (uint64). A text of fewer words has its whole sequence as one; one without words has none."""
    word, at = words(raw, offsets)
    n = len(word)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += word[j : n - width + 1 + j] * _PLACE[j] if n >= width else rolled
    rolled = mix(rolled)
    found = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            found.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            found.append(mix((word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
