"""Diagnostics of embedding tables, frozen-encoder inference and the contrastive loss as a metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions.expressions import one_row
from .effects import robust_summary, spearman
from .linear import column_means, fit_pca, principal_axes
from .sampling import subsample


def dimension_stats(df: DataFrame, vec: str, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, dim, n, mean, std, var, min, max): one aggregate over vector elements, no exploding of rows."""
    cells = []
    for i in range(dim):
        x = F.col(vec)[i].cast("double")
        cells.append(F.struct(
            F.lit(i).cast("bigint").alias("dim"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"),
        ))
    g = df.groupBy(*by).agg(F.array(*cells).alias("_d"))
    return g.select(*by, F.inline("_d")).withColumn("std", F.sqrt("var"))


def partition_report(stats: DataFrame, near_zero: float = 1e-8, by: Sequence[str] = ()) -> DataFrame:
    """Total, mean and median variance and the number of near-constant dimensions (d rows per group)."""
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dims"), F.sum("var").alias("total_variance"), F.avg("var").alias("mean_variance"),
        F.median("var").alias("median_variance"), F.count_if(F.col("var") <= near_zero).alias("near_zero_dims"),
    )


def norm_report(df: DataFrame, vec: str, outlier_z: float = 6.0) -> DataFrame:
    """Norm distribution, zero norms and outliers beyond outlier_z standard deviations, one row."""
    norms = df.select(A.norm(F.col(vec)).alias("norm"))
    stats = norms.agg(F.avg("norm").alias("m"), F.stddev_pop("norm").alias("s"))
    p = one_row(stats)
    scored = norms.select("norm", p["m"].alias("_m"), p["s"].alias("_s"))
    far = (F.col("_s") > 0) & (F.abs(F.col("norm") - F.col("_m")) > outlier_z * F.col("_s"))
    extra = scored.agg(F.count_if(F.col("norm") == 0).alias("zero_norms"), F.count_if(far).alias("outliers"))
    e = one_row(extra)
    out = robust_summary(norms, "norm")
    return out.select("*", e["zero_norms"].alias("zero_norms"), e["outliers"].alias("outliers"))


def covariance_report(spark: SparkSession, df: DataFrame, vec: str, floor: float = 1e-10) -> DataFrame:
    """Rank, extreme eigenvalues, their sum and sum of squares, and condition number of the covariance, from the triangular factor of the rows."""
    model = principal_axes(df, vec)
    w = model.scatter / model.n
    pos = w[w > floor]
    rank = int((np.sqrt(model.scatter) > np.sqrt(model.scatter.max()) * max(model.n, len(w)) * np.finfo(float).eps).sum())
    row = (rank, int(len(pos)), float(w[0]), float(w[-1]), float(w.sum()), float((w * w).sum()), float(pos[-1]) if len(pos) else None,
           float(pos[0] / pos[-1]) if len(pos) else None)
    return spark.createDataFrame(
        [row], "rank bigint, positive bigint, largest double, smallest double, trace double, squares double, smallest_positive double, condition double")


def pca_report(spark: SparkSession, df: DataFrame, vec: str) -> DataFrame:
    """Components needed for 90, 95 and 99 % of the variance and the first ratios: (metric, value)."""
    model = fit_pca(df, vec, 0.95)
    rows = [(f"components_{int(s * 100)}", float(model.needed(s))) for s in (0.90, 0.95, 0.99)]
    total = np.cumsum(model.ratios)
    for i, r in enumerate(model.ratios[:10]):
        rows += [(f"ratio_{i + 1:02d}", float(r)), (f"cumulative_{i + 1:02d}", float(total[i]))]
    return spark.createDataFrame(rows, "metric string, value double")


def partition_shift(df: DataFrame, vec: str, dim: int, partition: str = "partition", train: str = "train", held: str = "validation") -> DataFrame:
    """Train-to-held-out shift: L2 of mean difference, standardised shift (L2, mean and max size), the
    variance ratio (mean, median, min, max) and the norm shift in training std: one row."""
    two = df.where(F.col(partition).isin(train, held))
    s = dimension_stats(two, vec, dim, [partition])
    a = s.where(F.col(partition) == train).select("dim", F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = s.where(F.col(partition) == held).select("dim", F.col("mean").alias("mb"), F.col("var").alias("vb"))
    eps = F.lit(1e-12)
    j = a.join(b, "dim").select(
        (F.col("mb") - F.col("ma")).alias("_d"), ((F.col("mb") - F.col("ma")) / F.greatest(F.sqrt("va"), eps)).alias("_z"),
        (F.col("vb") / F.greatest("va", eps)).alias("_r"),
    )
    norms = two.select(partition, A.norm(F.col(vec)).alias("_n")).agg(
        F.avg(F.when(F.col(partition) == train, F.col("_n"))).alias("a"), F.avg(F.when(F.col(partition) == held, F.col("_n"))).alias("b"),
        F.stddev_pop(F.when(F.col(partition) == train, F.col("_n"))).alias("s"),
    )
    z = norms.select((F.col("b") - F.col("a")) / F.greatest("s", eps)).scalar()
    return j.agg(
        F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("mean_shift_l2"), F.sqrt(F.sum(F.col("_z") * F.col("_z"))).alias("std_shift_l2"),
        F.avg(F.abs("_z")).alias("std_shift_mean"), F.max(F.abs("_z")).alias("std_shift_max"), F.avg("_r").alias("var_ratio_mean"),
        F.median("_r").alias("var_ratio_median"), F.min("_r").alias("var_ratio_min"), F.max("_r").alias("var_ratio_max"),
    ).withColumn("norm_shift_z", z)


def scale_vector(df: DataFrame, vec: str, train: DataFrame, dim: int, out: str = "scaled") -> DataFrame:
    """Vector z-scored with training means and population std (0 -> 1)."""
    p = dimension_stats(train, vec, dim)
    packed = p.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("p"))
    row = df.withColumn("_p", packed.scalar())
    z = F.zip_with(F.col(vec), F.col("_p"), lambda x, q: (x.cast("double") - q["mean"]) / F.when(q["std"] > 0, q["std"]).otherwise(1.0))
    return row.withColumn(out, z).drop("_p")


def pca_shift(
    spark: SparkSession, df: DataFrame, vec: str, dim: int, partition: str = "partition", train: str = "train", held: str = "validation", variance: float = 0.95
) -> DataFrame:
    """Distance of the partition means in the space of a training-fitted scaling and PCA."""
    tr = df.where(F.col(partition) == train)
    scaled = scale_vector(df, vec, tr, dim)
    model = fit_pca(scaled.where(F.col(partition) == train), "scaled", variance)
    # the projection is linear: projecting the two mean vectors equals averaging projected rows
    means = [column_means(scaled.where(F.col(partition) == p), "scaled", dim) for p in (train, held)]
    shift = float(np.linalg.norm((means[1] - means[0]) @ model.components))
    return spark.createDataFrame([(model.components.shape[1], shift)], "components bigint, mean_shift_l2 double")


def sampled_pairs(df: DataFrame, key: str, sample: int, pairs: int, seed: int) -> DataFrame:
    """`pairs` random pairs (pair, a, b) of two different sampled rows, from hashes of the pair number."""
    s = subsample(df.select(key), key, sample, seed)
    from ..functions.ordering import row_numbers

    h = s.withColumn("_h", H.digest(seed, key))
    idx = row_numbers(h, [], ["_h", key], H.bucket(F.col("_h")), "_rn").select(key, (F.col("_rn") - 1).alias("_i"))
    n = s.agg(F.count(F.lit(1))).scalar()
    draws = df.sparkSession.range(pairs).select(F.col("id").alias("pair"), n.alias("_n"))
    i = F.pmod(H.draw(seed, F.lit("first"), "pair"), F.col("_n"))
    shift = F.lit(1) + F.pmod(H.draw(seed, F.lit("second"), "pair"), F.col("_n") - 1)
    picked = draws.where(F.col("_n") > 1).select("pair", i.alias("_a"), F.pmod(i + shift, F.col("_n")).alias("_b"))
    a = idx.select(F.col("_i").alias("_a"), F.col(key).alias("a"))
    b = idx.select(F.col("_i").alias("_b"), F.col(key).alias("b"))
    return picked.join(a, "_a").join(b, "_b").select("pair", "a", "b")


def pair_distances(pairs: DataFrame, embeddings: DataFrame, key: str, vec: str, seed: str = "seed") -> DataFrame:
    """(seed, pair, dist) of the sampled pairs under each seed's embeddings. The pair table is small
    and decides which embedding rows are read on."""
    left = embeddings.select(seed, F.col(key).alias("a"), F.col(vec).alias("_x"))
    right = embeddings.select(seed, F.col(key).alias("b"), F.col(vec).alias("_y"))
    j = pairs.join(left, "a").join(right, [seed, "b"])
    d = F.sqrt(A.squared_distance(F.transform("_x", lambda x: x.cast("double")), F.transform("_y", lambda y: y.cast("double"))))
    return j.select(seed, "pair", d.alias("dist"))


def geometry_similarity(dist: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Spearman of the pair distances for every pair of seeds: (seed_a, seed_b, rho, n)."""
    picks = [F.max(F.when(F.col("seed") == s, F.col("dist"))) for s in seeds]
    wide = dist.groupBy("pair").agg(F.array(*picks).alias("_v"))
    cells = [
        F.struct(F.lit(a).cast("bigint").alias("seed_a"), F.lit(b).cast("bigint").alias("seed_b"), F.col("_v")[i].alias("_p"), F.col("_v")[j].alias("_q"))
        for i, a in enumerate(seeds) for j, b in enumerate(seeds) if i < j
    ]
    return spearman(wide.select(F.inline(F.array(*cells))), "_p", "_q", ["seed_a", "seed_b"])


# ---- frozen encoder ----------------------------------------------------------------------------


def encoder_weights(seed: int = 0, channels: Sequence[int] = (3, 32, 64, 128), kernels: Sequence[int] = (7, 5, 3), dim: int = 64) -> dict[str, np.ndarray]:
    """Weights of the right shapes for tests; real ones are loaded from a parameter file."""
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for i, k in enumerate(kernels):
        fan = channels[i] * k
        w[f"conv{i}"] = rng.normal(0, 1 / np.sqrt(fan), (channels[i + 1], channels[i], k)).astype(np.float32)
        w[f"bn{i}"] = np.stack([np.ones(channels[i + 1]), np.zeros(channels[i + 1]), np.zeros(channels[i + 1]), np.ones(channels[i + 1])]).astype(np.float32)
    w["linear"] = rng.normal(0, 1 / np.sqrt(channels[-1]), (dim, channels[-1])).astype(np.float32)
    w["bias"] = np.zeros(dim, dtype=np.float32)
    return w


# error function by a rational approximation with error below 2e-7
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _gelu(z: np.ndarray) -> np.ndarray:
    """In single precision, with as few arrays as possible."""
    v = np.abs(z)
    v *= np.float32(1 / np.sqrt(2.0))
    t = v * np.float32(0.3275911)
    t += 1
    np.reciprocal(t, out=t)
    p = t * np.float32(ERF[-1])
    for c in ERF[-2::-1]:
        p += np.float32(c)
        p *= t
    np.multiply(v, v, out=v)
    np.negative(v, out=v)
    p *= np.exp(v, out=v)
    # p is 1 - erf(|z| / sqrt 2)
    p *= z
    p *= np.float32(0.5)
    return np.where(z > 0, z - p, p)


def forward(x: np.ndarray, weights: dict[str, np.ndarray], rows: int = 4) -> np.ndarray:
    """Embeddings of rows x channels x samples. A few rows at a time go through all layers, so that what lies between them stays in the processor's cache; batch norm is a factor of the
    weights and a shift."""
    n, _, length = x.shape
    layers = []
    for name in sorted(k for k in weights if k.startswith("conv")):
        w, (gamma, beta, mean, var) = weights[name], weights["bn" + name[4:]]
        factor = gamma / np.sqrt(var + 1e-5)
        kernel = (w * factor[:, None, None]).transpose(2, 1, 0).reshape(-1, len(w))
        layers.append((w.shape[2], np.ascontiguousarray(kernel, dtype=np.float32), (beta - mean * factor).astype(np.float32)))
    out = np.zeros((n, len(weights["bias"])), dtype=np.float32)
    for s in range(0, n, rows):
        y = x[s : s + rows].transpose(0, 2, 1)
        for k, kernel, shift in layers:
            padded = np.zeros((len(y), length + k - 1, y.shape[2]), dtype=np.float32)
            padded[:, k // 2 : k // 2 + length] = y
            # samples lie one after the other, so a window is a run of numbers
            win = np.lib.stride_tricks.as_strided(padded, (len(y), length, k * y.shape[2]), padded.strides)
            z = win.reshape(len(y) * length, -1) @ kernel
            z += shift
            y = _gelu(z).reshape(len(y), length, -1)
        out[s : s + rows] = y.mean(axis=1, dtype=np.float64) @ weights["linear"].T + weights["bias"]
    return out


def encode(df: DataFrame, weights: dict[str, np.ndarray], channels: Sequence[str] = ("sin_angle", "cos_angle", "speed"), out: str = "embedding") -> DataFrame:
    """Frozen inference: same-length convolutions with batch norm (gamma, beta, mean, var) and GELU,
    mean over time, linear layer. Weights travel with the task; rows go through in Arrow batches."""

    @F.arrow_udf("array<float>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        n = len(a)
        length = len(a.flatten()) // max(n, 1)
        x = np.stack([np.asarray(col.flatten(), dtype=np.float32).reshape(n, length) for col in (a, b, c)], axis=1)
        e = forward(x, weights)
        offsets = pa.array(np.arange(0, e.size + 1, len(weights["bias"]), dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(e.reshape(-1)))

    return df.withColumn(out, run(*[F.col(c) for c in channels]))


# ---- contrastive loss --------------------------------------------------------------------------


def batch_of(index: str, size: int) -> Column:
    """Batch number of a contiguous row index."""
    return F.floor(F.col(index) / size)


def contrastive_loss(pairs: DataFrame, batch: str, view_a: str, view_b: str, temperature: float = 0.10, max_batch: int = 4096) -> DataFrame:
    """NT-Xent of two views per batch: (batch, n, loss). A batch has a fixed number of rows (see
    `batch_of`), meets in one task as two matrices and leaves as one row; a larger one is an error."""
    kind = dict(pairs.dtypes)[batch]

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_batch:
            raise ValueError(f"batch of {len(pdf)} rows, at most {max_batch} allowed")
        z = np.concatenate([np.stack(pdf[view_a]), np.stack(pdf[view_b])]).astype(np.float64)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        n = len(pdf)
        sim = z @ z.T / temperature
        partner = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        own = sim[np.arange(2 * n), partner].copy()
        np.fill_diagonal(sim, -np.inf)
        top = sim.max(axis=1)
        lse = top + np.log(np.exp(sim - top[:, None]).sum(axis=1))
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n": [n], "loss": [float((lse - own).mean())]})

    return pairs.select(batch, view_a, view_b).groupBy(batch).applyInPandas(loss, f"{batch} {kind}, n long, loss double")


def mean_loss(losses: DataFrame) -> DataFrame:
    """Mean over batches weighted by their size."""
    return losses.agg(F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
