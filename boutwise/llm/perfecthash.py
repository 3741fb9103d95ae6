"""Minimal perfect hashing of distinct 64-bit keys, and counts held in its order.

Keys are thrown into a bit array; those alone in their place are settled there, the others go on to a smaller array. A settled key's number is the count of
set bits before its own, so n keys get the numbers 0..n-1 at about three bits a key. A key that was not built in gets any number or -1: callers
compare the key kept under the number.
"""

from __future__ import annotations

import numpy as np

from .textops import mix

SPREAD = 1.5  # places of an array for each key thrown into it


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        self.sizes, self.words = sizes, words
        self.before, n = [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        sizes, words = [], []
        left = np.ascontiguousarray(keys, np.int64)
        while len(left):
            size = 64 * (int(len(left) * SPREAD) // 64 + 1)
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        return cls(sizes, words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where it falls through all arrays."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, before) in enumerate(zip(self.sizes, self.words, self.before, strict=True)):
            if not len(left):
                break
            at = _places(np.ascontiguousarray(keys[left]), level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = before[at[hit] >> 6] + below[hit]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        return np.concatenate([np.array([len(self.sizes), *self.sizes], np.uint64), *self.words]).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        a = np.frombuffer(data, np.uint64)
        sizes = [int(x) for x in a[1:1 + int(a[0])]]
        ends = np.cumsum([0, *[s // 64 for s in sizes]]) + 1 + len(sizes)
        return cls(sizes, [a[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)])


class CountTable:
    """Counts of keys by their number, with the keys themselves."""

    def __init__(self, hash_: PerfectHash, keys: np.ndarray, counts: np.ndarray):
        self.hash, self.keys, self.counts = hash_, keys, counts

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for keys that are not in the table."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64)
        at = self.hash(keys)
        known = (at >= 0) & (self.keys[at] == keys)
        return np.where(known, self.counts[at], 0)
