"""Vectorised words, word hashes and shingle hashes of UTF-8 texts.

A word is a maximal run of bytes other than space and the controls 9 to 13,
with A-Z lower-cased; other letters stay as they are.  Everything works on the
flat byte buffer of an Arrow string column, so a text costs a few numpy passes
and no Python object per word.  Hashes are 64 bits wide and depend on the word
alone (never on the batch, the process or the machine).

Nulls and texts without words give documents with zero words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(256)


@dataclass
class Words:
    """Words of a batch of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray  # lower-cased bytes of all texts
    text_at: np.ndarray  # byte offsets of texts, one more than texts
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    first: np.ndarray  # word offsets of texts, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        global _POWERS
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        size = self.end - self.start
        if (longest := int(size.max())) > len(_POWERS):
            pow_ = powers(longest)
        else:
            pow_ = _POWERS
        # Only the bytes inside words, back to back.
        total = int(size.sum())
        begin = np.cumsum(size) - size
        at = np.arange(total) - np.repeat(begin, size)
        value = _BYTE[self.data[np.repeat(self.start, size) + at]]
        value *= pow_[at]
        return mix(np.add.reduceat(value, begin) + size.astype(U64) * _GOLD)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def words(column: pa.Array) -> Words:
    raw, at = flat(column)
    data = LOWER[raw]
    solid = ~SPACE[data]
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)  # a text begins here
    cut[at] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & ~(before & ~cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & ~(after & ~cut[1:])) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle and offsets by text, repeats included.

    A text of 1 to k-1 words has its whole sequence as its one shingle; a text
    without words has none.
    """
    count = np.diff(first)
    n = len(word_hash)
    rolled = np.full(n, k * int(_GOLD) % 2**64, dtype=U64)
    if n:
        for j in range(k):
            rolled[: n - j] = rolled[: n - j] * _MIX_B + word_hash[j:] if j < n else 0
    keep = np.zeros(n, dtype=bool)
    long_ = count >= k
    number = np.where(long_, count - k + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate(([0], np.cumsum(number)))
    total = int(offsets[-1])
    if total:
        pos = np.repeat(first[:-1] - offsets[:-1], number) + np.arange(total)
        keep = pos
    else:
        return np.zeros(0, dtype=U64), offsets
    out = mix(rolled[keep])
    for i in np.flatnonzero((count > 0) & ~long_):
        h = U64(count[i]) * _GOLD
        for x in word_hash[first[i] : first[i + 1]]:
            h = h * _MIX_B + x
        out[offsets[i]] = mix(np.array([h], dtype=U64))[0]
    return out, offsets


def distinct_by_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, with new offsets."""
    v = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        v[a:b].sort()
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = v[1:] != v[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return v[fresh], kept[offsets]


def slices(column: pa.Array, most: int):
    """Cut a string column into runs of rows of at most ``most`` bytes (a longer text stands alone)."""
    raw_at = flat(column)[1]
    i, n = 0, len(raw_at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(raw_at, raw_at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
