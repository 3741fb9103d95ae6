"""Whole texts of an Arrow batch as word and byte arrays.

A batch is walked in slices of about `SLICE` bytes so that the temporary arrays stay small whatever the batch or the text length is; a single
longer text makes a slice of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.cumprod(np.full(n - 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    return out


_POW = _powers(1024)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


LETTERS = np.zeros(256, bool)  # ASCII letters, and every byte of other characters
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_table(data: np.ndarray, offsets: np.ndarray, lower: bool = True, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, number of words per text); words are runs of bytes other than the six ASCII blanks, or of
    the bytes marked by `of`, within one text."""
    b = _LOWER[data] if lower else data
    n = len(b)
    if n == 0:
        z = np.empty(0, np.int64)
        return b, z, z, np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[b] if of is None else of[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return b, starts, ends, counts


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; the same word has the same hash in every task."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    length = ends - starts
    longest = int(length.max())
    global _POW
    if longest > len(_POW):
        _POW = _powers(longest)
    # positions of the words' bytes only, one after the other
    base = np.concatenate(([0], np.cumsum(length)[:-1]))
    total = int(length.sum())
    within = np.arange(total) - np.repeat(base, length)
    where = within + np.repeat(starts, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[b[where]] * _POW[within], base)
        return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text) of the k-word shingles of each text; a text of 1..k-1 words has one, its whole sequence."""
    n = len(words)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if n == 0:
        return np.empty(0, np.uint64), per
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    at = np.arange(len(doc)) - first[doc] + begin[doc]
    size = np.minimum(counts, k)[doc]
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(k):
            w = padded[at + j]
            if j:
                w = np.where(j < size, w, np.uint64(0))
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + w)
    return h, per


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
