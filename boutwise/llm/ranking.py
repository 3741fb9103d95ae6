"""Ranked lexical search: the terms of all items in one automaton, which is run over the text of every document.

An Aho-Corasick automaton over the items' terms, each between two guards, finds every occurrence of every term in one pass over a text whose separators
have become guards; it's sent to the tasks, and no index of the documents is made. An output is a term's number, and a table of postings maps it
to the items that have the term. A first pass counts documents, their terms and the documents of each term; a second pass scores.

Terms are the maximal runs of characters other than the ASCII ones that are no letter or digit; only A-Z are lower-cased. With N documents that have a term,
L terms in all, n terms of a document, df documents with a term: w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, and the score sums
w * ((10^9 tf) div (1000 tf + 20 m)) over the distinct terms of the item.

Defined results: null texts have no terms; rows of one item id are one item with the terms of all of them, a null id is an id; an item without terms or
without a document above 0 has no rows; repeated documents are ranked one by one; equal scores go by id, null ids last; empty tables give an empty
result; further columns are ignored.

Scale: two passes over the documents, no shuffle of texts or hits. A task keeps the k best of each item so far, so it sends k rows an item at most, and its memory
is the automaton and a block of documents x items. Items are taken in blocks of about `BLOCK_TERMS` (item, term) pairs by hash of their id, each with two
passes of its own, so the broadcast is bounded whatever the number of items; one item is never split. Integers stay below 2^63 while n x N is below 1.8e17.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import slices

BLOCK_TERMS = 400_000
K = 50
CELLS = 1 << 20  # cells of a block of documents x items
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

# bytes of a text: letters and digits of ASCII, lower-cased, and bytes of other characters stay; all others are the guard
_GUARD = 0x20
_FOLD = np.full(256, _GUARD, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

_automata: dict[str, object] = {}


def fold(text: str | None) -> bytes:
    """The text between two guards, as bytes."""
    return b" " + (text or "").encode().translate(_FOLD.tobytes()) + b" "


def automaton(name: str, terms: list[str]):
    """Automaton of the guarded terms, numbered as they come; one at a time is kept in a worker. Bytes stand as characters of the same number."""
    if name not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(fold(t).decode("latin-1"), i)
        a.make_automaton()
        _automata.clear()
        _automata[name] = a
    return _automata[name]


def _hits(batch: pa.RecordBatch, at: int, find, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a batch: (first row, number of terms of each row, row of each found term, its number, its count). Rows count from the slice's first."""
    for first, data, offsets in slices(batch.column(at)):
        folded = _FOLD[data]
        solid = folded != _GUARD
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(solid))]
        start[edge] |= solid[edge]
        n = np.diff(np.concatenate(([0], np.cumsum(start)))[offsets])
        raw = folded.tobytes().decode("latin-1")
        rows, found = [], []
        for r in range(len(offsets) - 1):
            if n[r]:
                got = np.fromiter((v for _, v in find(f" {raw[offsets[r]:offsets[r + 1]]} ")), np.int64)
                if len(got):
                    rows.append(np.full(len(got), r, np.int64))
                    found.append(got)
        if rows:
            cell, tf = np.unique(np.concatenate(rows) * width + np.concatenate(found), return_counts=True)
            yield first, n, cell // width, cell % width, tf
        else:
            none = np.empty(0, np.int64)
            yield first, n, none, none, none


def _count(name: str, shared):
    """Per task: (term, documents with it); term -1 has the documents with any term, -2 their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value[0]
        find = automaton(name, terms).iter
        df, some, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, n, _, found, _ in _hits(batch, 0, find, max(1, len(terms))):
                df += np.bincount(found, minlength=len(terms))
                some += int((n > 0).sum())
                length += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), -1, -2], pa.int64()), pa.array([*df[seen].tolist(), some, length], pa.int64())], ["term", "n"])

    return run


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * items
        self.id = [np.empty(0, np.int64)] * items
        self.none = [np.empty(0, bool)] * items
        self.floor = np.ones(items, np.int64)  # a lower score can't get in

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """scores: documents x items."""
        fits = scores >= self.floor
        for i in np.flatnonzero(fits.any(axis=0)):
            rows = np.flatnonzero(fits[:, i])
            s = np.concatenate((self.score[i], scores[rows, i]))
            d, z = np.concatenate((self.id[i], ids[rows])), np.concatenate((self.none[i], none[rows]))
            first = np.lexsort((d, z, -s))[:self.k]
            self.score[i], self.id[i], self.none[i] = s[first], d[first], z[first]
            if len(first) == self.k:
                self.floor[i] = s[first[-1]]


def _rank(name: str, shared, documents: int, length: int, k: int):
    """Per task: (item number, doc_id, score) of the k best documents of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, start, items, count = shared.value
        find = automaton(name, terms).iter
        size = np.diff(start)
        best = Best(count, k)
        step = max(1, CELLS // max(1, count))
        for batch in batches:
            column = batch.column(0)
            none = np.asarray(column.is_null())
            ids = column.fill_null(0).to_numpy(zero_copy_only=False)
            for first, n, row, term, tf in _hits(batch, 1, find, max(1, len(terms))):
                m = np.array([50 + (50 * int(x) * documents) // length for x in n], np.int64) if length else np.full(len(n), 50, np.int64)
                value = weight[term] * gains(tf, m[row])
                for lo in range(0, len(n), step):
                    a, b = np.searchsorted(row, (lo, lo + step))
                    if a == b:
                        continue
                    # every hit goes to the items of its term
                    per = size[term[a:b]]
                    begin = np.cumsum(per) - per
                    to = items[np.arange(per.sum()) - np.repeat(begin, per) + np.repeat(start[term[a:b]], per)]
                    rows = min(step, len(n) - lo)
                    cell = np.repeat(row[a:b] - lo, per) * count + to
                    scores = np.zeros(rows * count, np.int64)
                    np.add.at(scores, cell, np.repeat(value[a:b], per))
                    at = slice(first + lo, first + lo + rows)
                    best.add(scores.reshape(rows, count), ids[at], none[at])
        for i in range(count):
            if len(best.score[i]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.score[i]), i), pa.int64()), pa.array(best.id[i], pa.int64(), mask=best.none[i]),
                                                  pa.array(best.score[i], pa.int64())], ["item", "doc_id", "score"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    plain = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = item_terms(items, item_col, item_text)
    kind = items.schema[item_col].dataType
    blocks = max(1, -(-terms.count() // block_terms))
    out = None
    for b in range(blocks):
        found = _block(spark, texts, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, kind)
        out = found if out is None else out.unionByName(found)
    return out


def _block(spark, texts: DataFrame, terms: DataFrame, k: int, kind) -> DataFrame:
    rows = terms.orderBy("term", F.col("item_id").asc_nulls_last()).toArrow()
    if not rows.num_rows:
        return texts.where("false").select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    words = rows.column("term").combine_chunks().dictionary_encode()
    names = words.dictionary.to_pylist()
    number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = rows.column("item_id").to_pylist()
    index: dict = {}
    items = np.array([index.setdefault(i, len(index)) for i in ids], np.int64)
    start = np.searchsorted(number, np.arange(len(names) + 1))
    name = f"{id(rows)}:{len(names)}:{hash(tuple(names))}"
    counted = texts.select("text").mapInArrow(_count(name, spark.sparkContext.broadcast((names,))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    documents, length = df.get(-1, 0), df.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(names))], np.int64)
    shared = spark.sparkContext.broadcast((names, weight, start, items, len(index)))
    best = texts.mapInArrow(_rank(name, shared, documents, length, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the items' own ids: at most block_terms rows, from the driver as they came
    key = spark.createDataFrame(pa.table({"number": pa.array(range(len(index)), pa.int64()), "item_id": pa.array(list(index), rows.schema.field("item_id").type)}))
    key = key.select("number", F.col("item_id").cast(kind).alias("item_id"))
    return top.join(F.broadcast(key), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")
