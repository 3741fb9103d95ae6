"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: counts of the next byte after contexts of up to three bytes, contexts seen less than `least` times pruned to
their suffix. A byte unseen in its context costs an escape (method C) and is predicted by the next shorter context without the bytes already
excluded, down to a uniform guess. Statistics are frozen after the fit, so the cost of every byte in every context is worked out once per
language, and a text's code length is a sum of table entries. The language with the shortest code wins; the score is its posterior
under equal priors.

Defined results: `und` with score 0 for null, empty or letterless texts, or if nothing could be learned; repeated rows are scored each; ties go to the
alphabetically first language; extra columns are left out; an empty table gives an empty result.

Scale: one pass without a shuffle for the scores. Every language is learned, from at most about `fit_documents` documents of it, taken by hash, and at most
`most_ngrams` of its byte sequences (documented bounds of a classifier's sample and size). Languages are fitted in groups of `group` over one alphabet, so their
code lengths compare; a group's broadcast tables are bounded by `most_contexts` contexts and MOST_CELLS costs an order, and grow with the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import slices

FIT_DOCUMENTS = 2_000
GROUP = 16  # languages whose tables are made together
MOST_NGRAMS = 400_000  # of a language
MOST_CONTEXTS = 16_000
MOST_CELLS = 24_000_000  # of the table of one order, over all languages of a group and symbols
LEAST = 4
UNKNOWN = "und"

_SHIFT = np.uint64(8)


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of every byte with the three before it; before a text's start stand zero bytes."""
    code = data.astype(np.uint64)
    for j in (1, 2, 3):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j] if len(data) > j else 0
        for k in range(j):
            at = offsets[:-1] + k
            before[at[at < offsets[1:]]] = 0
        code |= before << np.uint64(8 * j)
    return code


def _count(languages: list[str]):
    index = {v: i for i, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([index[v] for v in batch.column(1).to_pylist()], np.uint64)
            for first, data, offsets in slices(batch.column(0)):
                if len(data) == 0:
                    continue
                size = np.diff(offsets)
                code = _grams(data, offsets) | np.repeat(which[first:first + len(size)], size) << np.uint64(32)
                key, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["code", "n"])

    return run


class Model:
    """Frozen cost tables. cost[node * width + symbol] has the bits of that symbol per language; node[c3, c2, c1] is the longest kept context."""

    def __init__(self, languages: list[str], code: np.ndarray, n: np.ndarray, least: int = LEAST, most_contexts: int = MOST_CONTEXTS,
                 seen: np.ndarray | None = None):
        self.languages = languages
        self.others: list[Model] = []  # of the next groups of languages
        if not languages or len(code) == 0:
            self.languages = []
            return
        lang = (code >> 32).astype(np.int64)
        part = [(code >> (8 * j) & 255).astype(np.int64) for j in range(4)]
        seen = np.unique(part[0]) if seen is None else seen
        self.symbol = np.zeros(256, np.int64)  # 0: before the start, or a byte never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        w = self.width = len(seen) + 1
        s = [self.symbol[x] if j == 0 else np.where(x == 0, 0, self.symbol[x]) for j, x in enumerate(part)]
        many = len(languages)
        share = n / np.maximum(np.bincount(lang, n, many), 1)[lang]  # a language counts the same whatever its rows
        most_contexts = min(most_contexts, MOST_CELLS // (w * many))
        low = np.full((many, 1, w), 1 / w, np.float32)
        # orders 0..3: contexts of that order, kept if frequent in all languages together
        node = np.zeros(1, np.int64)  # row of low for each full context of the order below
        for order in range(4):
            context = np.zeros(len(code), np.int64)
            for j in range(order, 0, -1):
                context = context * w + s[j]
            total = np.bincount(context, n, w ** order)
            keep = np.flatnonzero(total >= (least if order else 0))
            if len(keep) > most_contexts:
                weight = np.bincount(context, share, w ** order)
                keep = np.sort(keep[np.argsort(-weight[keep], kind="stable")[:most_contexts]])
            # the suffix of a context drops its oldest symbol, the most significant digit
            suffix = np.arange(w ** order) % max(1, w ** (order - 1)) if order else np.zeros(1, np.int64)
            up = node[suffix]
            row = np.full(w ** order, -1, np.int64)
            row[keep] = np.arange(len(keep))
            fresh = np.empty((many, len(keep), w), np.float32)
            inside = row[context] >= 0
            for g in range(many):
                m = inside & (lang == g)
                c = np.bincount(row[context[m]] * w + s[0][m], n[m], len(keep) * w).reshape(len(keep), w)
                fresh[g] = _ppm(c, low[g][up[keep]])
            if order:
                node = np.where(row >= 0, row + low.shape[1], up)
                low = np.concatenate((low, fresh), axis=1)
            else:
                low, node = fresh, np.zeros(1, np.int64)
        self.node = node.astype(np.int32)
        self.cost = np.ascontiguousarray(-np.log2(low).transpose(1, 2, 0).reshape(-1, many), np.float32)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language of all groups."""
        if self.others:
            return np.hstack([m._lengths(data, offsets) for m in (self, *self.others)])
        return self._lengths(data, offsets)

    def _lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        s = self.symbol[data].astype(np.int32)
        n, w = len(s), self.width
        context = np.zeros(n, np.int32)
        for j in (3, 2, 1):
            before = np.zeros(n, np.int32)
            before[j:] = s[:-j] if n > j else 0
            for k in range(j):
                at = offsets[:-1] + k
                before[at[at < offsets[1:]]] = 0
            context = context * w + before
        bits = np.take(self.cost, self.node[context] * w + s, axis=0)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out


def _ppm(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Next-symbol probabilities: seen symbols c / (n + d), the others share the escape d / (n + d) as the lower order has it."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    there = counts > 0
    rest = np.where(there, 0.0, lower)
    free = rest.sum(1, keepdims=True)
    escape = np.where(free > 0, d, 0)
    p = np.where(there, counts / np.maximum(n + escape, 1), 0.0)
    p += np.divide(rest, free, out=np.zeros_like(rest), where=free > 0) * np.where(n > 0, escape / np.maximum(n + escape, 1), 1.0)
    return np.maximum(p, 1e-12)


def remainder(id_col: str, by: int = 5) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_documents: int = FIT_DOCUMENTS, group: int = GROUP,
        most_ngrams: int = MOST_NGRAMS, most_contexts: int = MOST_CONTEXTS, least: int = LEAST) -> Model:
    """Context trees from labelled rows; rows without text or language teach nothing."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.empty(0), np.empty(0))
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, fit_documents / r["count"]) * (1 << 20)))])
    some = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < shares[F.col("lang")])
    which = F.shiftright("code", 32)
    got = some.mapInArrow(_count(languages), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy(which).orderBy(F.desc("n"), "code"))
    got = got.withColumn("__rank", best).where(F.col("__rank") <= most_ngrams).drop("__rank").persist()
    try:
        seen = np.array(sorted(r[0] for r in got.select(F.col("code").bitwiseAND(F.lit(255))).distinct().collect()), np.int64)
        models = []
        for lo in range(0, len(languages), group):
            names = languages[lo:lo + group]
            part = got.where((which >= lo) & (which < lo + group)).toPandas()
            code = part["code"].to_numpy(np.int64) - (lo << 32)
            if len(code):
                models.append(Model(names, code, part["n"].to_numpy(np.float64), least, most_contexts, seen))
    finally:
        got.unpersist()
    if not models:
        return Model([], np.empty(0), np.empty(0))
    models[0].others = models[1:]
    return models[0]


def _letters(column: pa.Array, first: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    low = data | 32
    ascii_ = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    some = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(c.isalpha() for c in column[int(first + i)].as_py() or "")
    return some


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, *(v for x in m.others for v in x.languages), UNKNOWN], object)
        for batch in batches:
            pred, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for first, data, offsets in slices(batch.column(batch.num_columns - 1)):
                if not m.languages or len(data) == 0:
                    continue
                bits = m.lengths(data, offsets)
                best = bits.argmin(1)
                p = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                ok = _letters(batch.column(batch.num_columns - 1), first, data, offsets)
                at = slice(first, first + len(best))
                pred[at], score[at] = np.where(ok, best, len(names) - 1), np.where(ok, p, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[pred], pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, lang_pred and score."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    told = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(_score(told), f"{schema}, lang_pred string, score double")
