"""Toxicity by a classifier chain over label columns.

The categories are predicted one after the other by logistic regressions; each model sees the text's features and the probabilities of the earlier categories.
In training those probabilities come from out-of-fold models, so a later model learns from what it will meet. Features are the presence of letter
runs and of their first bytes (lower-cased, by 64-bit hash), the `most_features` with the largest chi-square a category (counted by Spark), and binned shares of capitals, digits and
marks with the text's length.

Defined results: null and empty texts score 0 in every category; rows whose labels hold a null aren't learned from, repeated labels of one id count once,
by their largest values; a category with one value only, or no labelled row, scores that value, or 0; repeated rows score alike; an empty
table gives an empty result; a suffix keeps the scores apart from like-named columns.

Scale: the scores are one pass without a shuffle. The fit reads the documents of at most about `fit_rows` labelled ids, taken by hash (the documented bound
of a classifier's sample); that list alone is broadcast, and the models are bounded by `most_features` weights a category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LETTERS, mix, slices, word_hashes, word_table

FIT_ROWS = 8_000
MOST_FEATURES = 4_000
FOLDS = 3
L2 = 0.1
STEPS = 150

STEMS = (4, 5)  # bytes of word beginnings that are features too
_STYLE = np.uint64(0x5EED)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text): letter runs and their beginnings, with repeats, and four style features of each text that has bytes."""
    b, starts, ends, counts = word_table(data, offsets, of=LETTERS)
    whole, length = word_hashes(b, starts, ends), ends - starts
    kinds = [whole]
    for k in STEMS:
        # the first k bytes as one number; shorter words stand for themselves
        code = np.full(len(starts), k, np.uint64)
        for j in range(k):
            code = code << np.uint64(8) | b[np.minimum(starts + j, max(0, len(b) - 1))]
        kinds.append(np.where(length > k, mix(code), whole))
    words = np.stack(kinds, 1).ravel()
    counts = counts * len(kinds)
    size = np.diff(offsets)
    full = size > 0
    style = []
    for lo, hi in ((65, 90), (48, 57), (33, 47)):
        cum = np.concatenate(([0], np.cumsum((data >= lo) & (data <= hi))))
        style.append(np.minimum(9, (cum[offsets[1:]] - cum[offsets[:-1]]) * 20 // np.maximum(size, 1)))
    style.append(np.log2(np.maximum(size, 1)).astype(np.int64))
    style = np.stack(style, 1).astype(np.uint64) + np.arange(1, 5, dtype=np.uint64) * np.uint64(1000)
    with np.errstate(over="ignore"):
        extra = mix(style * _STYLE + np.uint64(7))[full]
    per = counts + 4 * full
    out = np.empty(int(per.sum()), np.uint64)
    first = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    out[np.arange(len(words)) + np.repeat(first - begin, counts)] = words
    if full.any():
        out[((first + counts)[full][:, None] + np.arange(4)).ravel()] = extra.ravel()
    return out, per


def _presences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, int]]:
    """(batch, first row, distinct features, their rows from 0, number of rows) of each slice."""
    for batch in batches:
        for first, data, offsets in slices(batch.column(column)):
            h, per = features(data, offsets)
            row = np.repeat(np.arange(len(per)), per)
            yield batch, first, *distinct(h, row), len(per)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _counts(many: int):
    """Per feature the number of texts that have it, and of those in each category; the feature 0 stands for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, h, row, n in _presences(batches, 1):
            y = [batch.column(2 + i).slice(first, n).to_numpy(zero_copy_only=False).astype(float) for i in range(many)]
            keys, at = np.unique(h, return_inverse=True)
            cols = [np.bincount(at, minlength=len(keys)), *(np.bincount(at, v[row], len(keys)) for v in y)]
            keys, cols = np.append(keys, np.uint64(0)), [np.append(c, t) for c, t in zip(cols, [n, *(v.sum() for v in y)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols)], ["h", "n", *(f"p{i}" for i in range(many))])

    return run


def _chosen(hashes):
    """Rows with the places of the features they have among the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hashes.value
        for batch, first, h, row, n in _presences(batches, 1):
            code = np.searchsorted(keys, h)
            k = code < len(keys)
            k[k] = keys[code[k]] == h[k]
            at = np.concatenate(([0], np.cumsum(np.bincount(row[k], minlength=n)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(code[k].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for i, c in enumerate(batch.columns) if i != 1), lists],
                                             [*(x for i, x in enumerate(batch.schema.names) if i != 1), "features"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


PART = 1 << 20


def _added(at: np.ndarray, values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sum of values[by] per place `at`, in parts so that no array of 64-bit numbers is as long as `at`."""
    out = np.zeros(n)
    for lo in range(0, len(at), PART):
        out += np.bincount(at[lo:lo + PART], values[by[lo:lo + PART]], n)
    return out


class Linear:
    """Logistic regression on sparse presences and dense probabilities, by Adam on the whole sample. A presence is the place of its feature in `keys` and its row."""

    def __init__(self, keys: np.ndarray, code: np.ndarray, row: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float, steps: int):
        n, p = len(y), float(y.mean()) if len(y) else 0.0
        self.hashes, self.weights, self.dense = np.empty(0, np.uint64), np.empty(0), np.zeros(dense.shape[1])
        if p in (0.0, 1.0):
            self.bias = 60 * p - 30
            return
        used = np.zeros(len(keys), bool)
        used[code] = True
        self.hashes, col = keys[used], (np.cumsum(used) - 1).astype(np.int32)[code]
        k = len(self.hashes)
        w = np.zeros(k + dense.shape[1] + 1)
        w[-1] = np.log(p / (1 - p))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = _added(row, w, col, n) + dense @ w[k:-1] + w[-1]
            e = (_sigmoid(z) - y) / n
            g = np.concatenate((_added(col, e, row, k), e @ dense, [e.sum()]))
            g[:-1] += l2 * w[:-1] / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        self.weights, self.dense, self.bias = w[:k], w[k:-1], float(w[-1])

    def predict(self, hashes: np.ndarray, row: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Rows' probabilities; hashes are distinct within a row."""
        z = dense @ self.dense + self.bias
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            ok = self.hashes[at] == hashes
            z = z + np.bincount(row[ok], self.weights[at[ok]], len(dense))
        return _sigmoid(z)


class Chain:
    def __init__(self, categories: list[str], keys: np.ndarray, code: np.ndarray, row: np.ndarray, labels: np.ndarray, fold: np.ndarray, wanted: list[np.ndarray],
                 folds: int = FOLDS, l2: float = L2, steps: int = STEPS):
        """keys: the chosen features in order; code and row (32 bits): the presences in the sample."""
        self.categories, self.models = categories, []
        n = len(labels)
        dense = np.zeros((n, 0))
        for c in range(len(categories)):
            y = labels[:, c] if n else np.empty(0)
            own = np.isin(keys, wanted[c])[code]
            mine, at = code[own], row[own]
            del own
            self.models.append(Linear(keys, mine, at, dense, y, l2, steps))
            if c + 1 == len(categories):
                break
            out = np.zeros(n)
            for f in range(folds):
                train = fold != f
                if train.all():
                    continue
                number = (np.cumsum(train) - 1).astype(np.int32)
                k = train[at]
                model = Linear(keys, mine[k], number[at[k]], dense[train], y[train], l2, steps)
                number = (np.cumsum(~train) - 1).astype(np.int32)
                out[~train] = model.predict(keys[mine[~k]], number[at[~k]], dense[~train])
            dense = np.column_stack((dense, out))
        used = np.concatenate([m.hashes for m in self.models]) if self.models else np.empty(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(used >> np.uint64(44)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One column a category."""
        n = len(offsets) - 1
        h, per = features(data, offsets)
        row = np.repeat(np.arange(n), per)
        k = self.seen[(h >> np.uint64(44)).astype(np.int64)]
        h, row = distinct(h[k], row[k])
        dense = np.zeros((n, 0))
        for m in self.models:
            dense = np.column_stack((dense, m.predict(h, row, dense)))
        dense[per == 0] = 0.0
        return dense


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
        folds: int = FOLDS, most_features: int = MOST_FEATURES, l2: float = L2, steps: int = STEPS) -> Chain:
    """The chain in the order of `categories`, columns of labels with 0 and 1."""
    known = (labels.select(F.col(id_col).alias("__id"), *(F.col(c).cast("int").alias(f"__y{i}") for i, c in enumerate(categories))).dropna()
             .groupBy("__id").agg(*(F.max(f"__y{i}").alias(f"__y{i}") for i in range(len(categories)))))
    share = min(1.0, fit_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.col("__text").isNotNull())
            .join(F.broadcast(some), "__id").dropDuplicates(["__id"]).select("__id", "__text", *(f"__y{i}" for i in range(len(categories)))))
    many, context = len(categories), docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    counts = (rows.mapInArrow(_counts(many), "h long, n long, " + ", ".join(f"p{i} long" for i in range(many))).groupBy("h")
              .agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(many))).where("n > 1 or h = 0").persist())
    try:
        wanted = [np.empty(0, np.uint64)] * many
        for total in counts.where("h = 0").collect():
            for i in range(many):
                n, p = total["n"], total[f"p{i}"] / total["n"]
                if 0 < p < 1:
                    off = F.col(f"p{i}") - F.col("n") * F.lit(p)
                    chi = off * off / (F.col("n") * F.lit(p * (1 - p))) * n / F.greatest(F.lit(n) - F.col("n"), F.lit(1))
                    top = counts.where("h <> 0").select("h", chi.alias("chi")).orderBy(F.desc("chi"), "h").limit(most_features)
                    wanted[i] = np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))
    finally:
        counts.unpersist()
    keys = np.unique(np.concatenate(wanted))
    got = (rows.mapInArrow(_chosen(context.broadcast(keys)), f"__id {kind}, " + ", ".join(f"__y{i} int" for i in range(many)) + ", features array<int>")
           .toArrow().sort_by("__id").combine_chunks())
    # flat 32-bit arrays from here on; the rows of the table are let go
    y = np.column_stack([got.column(f"__y{i}").to_numpy().astype(float) for i in range(many)])
    lists = got.column("features").combine_chunks()
    code = lists.flatten().to_numpy().astype(np.int32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    del got, lists
    fold = (mix(np.arange(len(y), dtype=np.uint64)) % np.uint64(folds)).astype(np.int64)
    return Chain(list(categories), keys, code, row, y, fold, wanted, folds, l2, steps)


def _score(told, suffix: str, at: int, keep: int):
    """at: the text's column; keep: how many of the first columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = told.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(chain.categories)))
            for first, data, offsets in slices(batch.column(at)):
                out[first:first + len(offsets) - 1] = chain.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(np.ascontiguousarray(x)) for x in out.T)],
                                             [*batch.schema.names[:keep], *(f"{c}{suffix}" for c in chain.categories)])

    return run


def score(docs: DataFrame, chain: Chain, keep: list[str], text_col: str = "text", suffix: str = "_score") -> DataFrame:
    """The columns to keep, and a probability <category><suffix> for each category."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}{suffix}` double" for c in chain.categories)])
    told = docs.sparkSession.sparkContext.broadcast(chain)
    # a text that is kept is sent once
    sent = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    src = docs.select(*keep) if sent else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(_score(told, suffix, keep.index(text_col) if sent else len(keep), len(keep)), schema)
