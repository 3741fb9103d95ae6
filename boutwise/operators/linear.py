"""Matrix products and factors over array columns: partial results per task, reduced by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as an (n, dim) float64 matrix without touching single rows. A missing vector or one of another
    length is an error: cut anew, the values would silently make other vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"every vector must have {dim} components")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


NEAR = 1e-6  # squared distances below this share of the squared lengths are taken from the differences
PAIRS = 1 << 14  # such pairs at once


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x from all rows of y by one matrix product; pairs so near that it would lose digits are computed from their differences."""
    mean = y.mean(axis=0)
    x, y = x - mean, y - mean
    scale = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    d = x @ y.T
    d *= -2
    d += scale
    scale *= NEAR
    a, b = np.nonzero(d <= scale)
    for lo in range(0, len(a), PAIRS):
        i, j = a[lo:lo + PAIRS], b[lo:lo + PAIRS]
        d[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def vector_of(cols: Sequence[str]) -> Column:
    """Scalar columns as one array<double> column."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def dimension(df: DataFrame, vec: str) -> int:
    return int(df.select(F.size(vec)).first()[0])


def column_means(df: DataFrame, vec: str, dim: int) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dim)]).first()
    return np.array([float(v) for v in row])


def gram(df: DataFrame, vec: str, dim: int, shift: np.ndarray | None = None) -> DataFrame:
    """Sum over rows of (x - shift)(x - shift)' as rows (i, n, row array<double>). A task sends one
    dim x dim block, whatever the number of its rows; the blocks are then added by row index."""
    centre = np.zeros(dim) if shift is None else shift

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            x = matrix(b.column(0), dim) - centre
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_pydict(
            {"i": list(range(dim)), "n": [n] * dim, "s": total.tolist()},
            schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]),
        )

    parts = df.select(vec).mapInArrow(partial, "i int, n long, s array<double>")
    return parts.groupBy("i").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dim)]).alias("row")
    )


def covariance(df: DataFrame, vec: str, dim: int | None = None) -> DataFrame:
    """Population covariance as rows (i, j, cov)."""
    dim = dim or dimension(df, vec)
    g = gram(df, vec, dim, column_means(df, vec, dim))
    return g.select("i", "n", F.posexplode("row").alias("j", "s")).select("i", "j", (F.col("s") / F.col("n")).alias("cov"))


def to_matrix(cells: DataFrame, dim: int, value: str = "cov") -> np.ndarray:
    """A dim x dim table of cells on the driver."""
    out = np.zeros((dim, dim))
    for r in cells.select("i", "j", value).collect():
        out[r[0], r[1]] = r[2]
    return out


def map_rows(df: DataFrame, vec: str, fn, width: int, out: str) -> DataFrame:
    """Adds `out` = fn(matrix) per Arrow batch; fn maps (n, d) to (n, width)."""
    dim = dimension(df, vec)

    @F.arrow_udf("array<double>")
    def apply(col: pa.Array) -> pa.Array:
        y = np.ascontiguousarray(fn(matrix(col, dim)), dtype=np.float64)
        offsets = pa.array(np.arange(0, len(y) * width + 1, width, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(y.reshape(-1)))

    return df.withColumn(out, apply(F.col(vec)))


FAN = 32  # factors stacked by one task


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular factor of the rows, with no negative number on its diagonal."""
    width = rows.shape[1]
    r = np.linalg.qr(np.concatenate((rows, np.zeros((max(0, width - len(rows)), width)))), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def triangular_factor(df: DataFrame, vec: str, dim: int) -> np.ndarray:
    """R of the QR factorisation of all rows [1, x], (d+1) x (d+1), in one scan. A task folds its rows into one triangle, and triangles are stacked and folded
    again, `FAN` at a time. The first row tells the number of rows and the mean, the rest is the factor of the centred rows; no products of numbers are
    summed, so small variances beside large ones, or beside a large mean, keep their digits."""
    schema = "task long, r binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim + 1))
        for b in batches:
            x = matrix(b.column(0), dim)
            for lo in range(0, len(x), 4096):
                part = x[lo:lo + 4096]
                r = _triangle(np.concatenate((r, np.concatenate((np.ones((len(part), 1)), part), axis=1))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    def stack(t: pa.Table) -> pa.Table:
        r = _triangle(np.concatenate([np.frombuffer(v.as_py()).reshape(dim + 1, dim + 1) for v in t.column("r")]))
        return pa.table({"task": t.column("task")[:1], "r": pa.array([r.tobytes()], pa.binary())})

    rows = df.select(vec)
    out = rows.mapInArrow(fold, schema)
    left = rows.rdd.getNumPartitions()  # metadata only
    while left > FAN:
        out = out.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task").applyInArrow(stack, schema)
        left = -(-left // FAN)
    # at most FAN triangles
    found = [np.frombuffer(v.as_py()).reshape(dim + 1, dim + 1) for v in out.toArrow().sort_by("task").column("r")]
    if not found:
        raise ValueError("no rows to fit on")
    return _triangle(np.concatenate(found))


@dataclass
class PcaModel:
    components: np.ndarray  # (d, k)
    mean: np.ndarray
    ratios: np.ndarray  # all d explained-variance ratios
    scatter: np.ndarray  # all d sums of squares along the components
    n: int

    def project(self, df: DataFrame, vec: str, out: str = "pc") -> DataFrame:
        comp, mean = self.components, self.mean
        return map_rows(df, vec, lambda x: (x - mean) @ comp, comp.shape[1], out)

    def needed(self, share: float) -> int:
        """Smallest number of components that reaches the share of variance."""
        return int(np.searchsorted(np.cumsum(self.ratios), share - 1e-12) + 1)


def principal_axes(df: DataFrame, vec: str, dim: int | None = None) -> PcaModel:
    """All components from the triangular factor of the rows; the largest entry of each is positive."""
    dim = dim or dimension(df, vec)
    r = triangular_factor(df, vec, dim)
    _, size, axes = np.linalg.svd(r[1:, 1:])
    sign = np.sign(axes[np.arange(dim), np.abs(axes).argmax(axis=1)])
    scatter = size**2
    total = scatter.sum()
    return PcaModel((axes * sign[:, None]).T, r[0, 1:] / r[0, 0], scatter / total if total > 0 else np.zeros(dim), scatter, int(round(r[0, 0] ** 2)))


def fit_pca(train: DataFrame, vec: str, variance: float | None = 0.95, k: int | None = None) -> PcaModel:
    """PCA of the training rows with a fixed number of components or the smallest that reaches the
    variance target. The fitted rotation is applied to centred data."""
    out = principal_axes(train, vec)
    dim = len(out.mean)
    out.components = out.components[:, : (k if k is not None else min(dim, out.needed(variance)))]
    return out


def axis_checks(df: DataFrame, vec: str, model: PcaModel) -> dict[str, float]:
    """How far the axes are from being the covariance's, by a covariance that is summed on its own: largest entries of V'V - I and of CV - V diag(variance),
    relative to the largest variance."""
    dim = len(model.mean)
    c = to_matrix(covariance(df, vec, dim), dim)
    v, w = model.components, model.scatter[: model.components.shape[1]] / model.n
    return {"orthonormality": float(np.abs(v.T @ v - np.eye(v.shape[1])).max()), "residual": float(np.abs(c @ v - v * w).max() / max(w.max(), 1e-300))}
