"""Nearest neighbours by few stable projections, a kd-tree and an early-termination test.

Vectors are scaled to unit length, so the largest cosine is the least Euclidean distance. Each is projected on `dims` Gaussian (2-stable) directions: for a distance
r the squared projected distance over r squared is chi-square with `dims` degrees of freedom. Within a block of candidates the projections are
indexed by a kd-tree; a query takes the tree's leaves in order of projected distance and verifies their vectors in double precision, until
the chi-square test says that an unseen vector nearer than the current k-th has at most the chance 1 - `confidence` to lie beyond the projected
distance reached so far.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; ties go to the smaller id; identical
vectors get identical scores, as every score is summed in the same order; repeated ids are candidates each, but never of a query with the
same id; fewer than k candidates are all returned; an empty table gives an empty result; extra columns are left out.

Scale: every row is indexed and is a candidate. Candidates go to blocks of about `block` rows and queries to blocks of about `query_block`, by hash of id and vector;
a task joins one block of each, so no task grows with the data, and only k rows a query and block leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 6
LEAF = 128
BLOCK = 16_384
QUERY_BLOCK = 4_096
CONFIDENCE = 0.98


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi-square <= x) for an even number of degrees of freedom (a finite sum)."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dims // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


class Tree:
    """kd-tree by median splits on the widest direction; leaves hold consecutive rows of `order` and their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                if hi > lo:
                    bounds.append((lo, hi))
                continue
            part = points[self.order[lo:hi]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], half)]
            todo += [(lo, lo + half), (lo + half, hi)]
        self.bounds = sorted(bounds)
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.bounds])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.bounds])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from a query to each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(1)


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, directions: np.ndarray, confidence: float = CONFIDENCE,
           leaf: int = LEAF) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, candidate ids, cosines) of the k nearest found in this block; several candidates may share an id."""
    norm = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / norm[:, None]
    tree = Tree(unit @ directions, leaf)
    limit = _quantile(confidence, directions.shape[1])
    qnorm = np.sqrt((queries * queries).sum(1))
    projected = (queries / qnorm[:, None]) @ directions
    for i in range(len(queries)):
        q = queries[i]
        near = tree.distances(projected[i])
        best_s, best_id = np.empty(0), np.empty(0, ids.dtype)
        for t in np.argsort(near, kind="stable"):
            if len(best_s) == k:
                # ties are wanted too, hence the small allowance
                kth = max(0.0, 2 - 2 * best_s[-1]) + 1e-12
                if near[t] > limit * kth:
                    break
            a, b = tree.bounds[t]
            rows = tree.order[a:b]
            cosine = (vectors[rows] * q).sum(1) / (norm[rows] * qnorm[i])
            other = ids[rows] != query_ids[i]
            s, c = np.concatenate((best_s, cosine[other])), np.concatenate((best_id, ids[rows][other]))
            top = np.lexsort((c, -s))[:k]
            best_s, best_id = s[top], c[top]
        yield i, best_id, best_s


def _quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), dims) < p else (lo, mid)
    return hi


def _join(k: int, dims: int, seed: int, confidence: float, leaf: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return kind.empty_table()
        cand, q = (np.stack(t.column("v").combine_chunks().to_numpy(zero_copy_only=False)).astype(float) for t in (left, right))
        ids, qids = left.column("id").to_numpy(), right.column("id").to_numpy()
        directions = np.random.default_rng(seed).standard_normal((cand.shape[1], dims))
        out = [(np.full(len(c), qids[i]), c, s) for i, c, s in search(cand, ids, q, qids, k, directions, confidence, leaf)]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=kind)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE,
            block: int = BLOCK, query_block: int = QUERY_BLOCK, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found."""
    if dims % 2:
        raise ValueError("an even number of directions is needed")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = raw.where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.sum(F.col("q").cast("long")).alias("queries")).orderBy(F.desc("rows"), "n").limit(1).collect()
    n, rows, queries = (sizes[0]["n"], sizes[0]["rows"], sizes[0]["queries"]) if sizes else (0, 0, 0)
    good = good.where(F.size("v") == n)
    blocks, query_blocks = max(1, -(-rows // block)), max(1, -(-queries // query_block))
    mine = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = good.select("id", "v", (mine % blocks).cast("int").alias("cb")).withColumn("qb", each(query_blocks))
    right = good.where("q").select("id", "v", (mine % query_blocks).cast("int").alias("qb")).withColumn("cb", each(blocks))
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(_join(k, dims, seed, confidence, leaf), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
