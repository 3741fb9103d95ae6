"""Packing of token sequences into windows by best-fit decreasing.

Each text becomes token ids plus one closing id. A document longer than the window is first cut into full windows, which are sequences of their own; what
is left of it, and every shorter document, goes longest first into the open window with the least room that still holds it. A segment tree
over the remaining capacities finds that window in log2(window) steps.

Defined results: a null or empty text is the closing id alone; repeated rows and repeated or null ids are documents of their own; an empty table gives an empty
result; further columns are ignored. Ties go by length, id, start and checksum, so a repeated task gives the same packing.

Scale: tokenising is one pass without a shuffle. Only the piece table (five numbers a piece) is dealt out evenly; each task packs what it gets,
and its windows that stay open are the only padding, a few for each task. Sequence ids hold the task number in the high bits.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
CLOSING = 0

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """texts -> lists of ids. The rank form of the same vocabulary, where a file of it lies beside, is several times faster; it serves texts of
    Latin letters without very long words, where both split alike, and the JSON tokenizer serves the others."""
    if path in _loaded:
        return _loaded[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    fast, safe = None, None
    if os.path.exists(ranks_path):
        import re

        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        extra = {t.content: i for i, t in full.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=extra)
        safe = re.compile("[\x00-\x7f¡-ʯ‐-‧€]*").fullmatch

    def encode(texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if fast is not None and (t.isascii() or safe(t)) and max(map(len, t.split()), default=0) < 2000 and not _blank_run(t):
                out[i] = fast.encode(t, allowed_special="all", disallowed_special=())
            else:
                slow.append(i)
        for i in slow:
            out[i] = full.encode(texts[i], add_special_tokens=False).ids
        return out

    _loaded[path] = encode
    return encode


def _blank_run(t: str) -> bool:
    return " " * 2000 in t or "\n" * 2000 in t or "\t" * 2000 in t


def _cut(window: int, path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(0).to_pylist()
                rows = []
                for doc, toks in zip(ids, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    a = np.array([*toks, CLOSING], "<u4")
                    for s in range(0, len(a), window):
                        piece = a[s:s + window]
                        rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(a), piece.astype(np.int32) if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over 0..capacity tells the least capacity >= n that is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def _mark(self, c: int, there: bool) -> None:
        i = c + self.size
        self.tree[i] = there
        i >>= 1
        while i:
            v = self.tree[2 * i] or self.tree[2 * i + 1]
            if self.tree[i] == v:
                break
            self.tree[i] = v
            i >>= 1

    def put(self, c: int, window: int) -> None:
        if c > 0:
            self.at[c].append(window)
            if len(self.at[c]) == 1:
                self._mark(c, True)

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for n; it's no longer open."""
        t, i = self.tree, n + self.size
        if not t[i]:
            while i > 1 and (i & 1 or not t[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if t[2 * i] else 2 * i + 1
        c = i - self.size
        w = self.at[c].pop()
        if not self.at[c]:
            self._mark(c, False)
        return c, w


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of pieces given longest first, each 1..window long."""
    open_, count = OpenWindows(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = open_.take(n)
        if found is None:
            c, w = window, count
            count += 1
        else:
            c, w = found
        number[k], offset[k] = w, window - c
        open_.put(c - n, w)
    return number, offset


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        number, offset = best_fit_decreasing(t.column("length").to_numpy(), window)
        number += TaskContext.get().partitionId() << 33
        t = t.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most `window` ids; with keep_ids also the ids."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_cut(window, tokenizer, keep_ids), PIECE + (", ids array<int>" if keep_ids else ""))


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with sequence_id and offset; every piece keeps its columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.hint("rebalance").mapInArrow(_pack(window), schema + ", sequence_id long, offset long")
