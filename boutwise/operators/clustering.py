"""Clustering fits, frozen assignment, confidence, occupancy, silhouette and model choice."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from .linear import distances, matrix
from .tiles import reduce_tiles, tile_count


STRIP = 2048  # rows of either side in one matrix of distances
TILES = 6


@dataclass
class Centres:
    """Fitted or chosen cluster centres, (k, d)."""

    values: np.ndarray
    cost: float | None = None

    @property
    def k(self) -> int:
        return len(self.values)


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float
    n: int

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k * d * (d + 1) // 2 + k - 1

    @property
    def bic(self) -> float:
        return float(-2 * self.log_likelihood + self.parameters * np.log(self.n))

    @property
    def aic(self) -> float:
        return float(-2 * self.log_likelihood + 2 * self.parameters)


def hashed_centres(df: DataFrame, key: str, vec: str, k: int, seed: int) -> Centres:
    """k rows chosen by hash order as centres: a reproducible start and a fixed test model."""
    rows = df.select(H.digest(seed, key).alias("_o"), key, vec).orderBy("_o", key).limit(k).collect()
    return Centres(np.array([[float(x) for x in r[2]] for r in rows]))


def _nearest_two(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dist = np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1))
    best = dist.argmin(axis=1)  # first index on ties
    if dist.shape[1] == 1:
        return best, dist[:, 0], np.full(len(x), np.nan)
    two = np.partition(dist, 1, axis=1)
    return best, two[:, 0], two[:, 1]


def assign_many(df: DataFrame, vec: str, models: dict[int, Centres], keep: Sequence[str], name: str = "seed", margins: bool = False) -> DataFrame:
    """Nearest centre of every row under each model, one output row per (row, model): columns keep,
    `name`, cluster and, with margins, d1 and d2. Centres (k x d) travel with the task; rows do not move."""
    ids = list(models)
    values = [models[i].values for i in ids]
    dim = values[0].shape[1]
    kind = pa.struct([("cluster", pa.int32()), ("d1", pa.float64()), ("d2", pa.float64())])

    @F.arrow_udf("array<struct<cluster:int,d1:double,d2:double>>")
    def nearest(col: pa.Array) -> pa.Array:
        x = matrix(col, dim)
        found = [_nearest_two(x, c) for c in values]
        flat = [np.stack([f[j] for f in found], axis=1).reshape(-1) for j in range(3)]
        cells = pa.StructArray.from_arrays(
            [pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2])], fields=list(kind)
        )
        offsets = pa.array(np.arange(0, len(x) * len(values) + 1, len(values), dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, cells)

    out = df.select(*keep, F.posexplode(nearest(F.col(vec))).alias("_m", "_a"))
    named = F.element_at(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("_m") + 1)
    cols = [*keep, named.alias(name), F.col("_a.cluster").cast("bigint").alias("cluster")]
    if margins:
        cols += [F.col("_a.d1").alias("d1"), F.col("_a.d2").alias("d2")]
    return out.select(*cols)


def assign(df: DataFrame, vec: str, centres: Centres, keep: Sequence[str], margins: bool = False) -> DataFrame:
    """Frozen nearest-centre assignment, first centre on ties."""
    return assign_many(df, vec, {0: centres}, keep, "_model", margins).drop("_model")


def margin(d1: str = "d1", d2: str = "d2") -> Column:
    """Mean relative gap between the two nearest centres."""
    return F.avg((F.col(d2) - F.col(d1)) / F.greatest(F.col(d2), F.lit(1e-12)))


def lloyd(df: DataFrame, vec: str, start: Centres, iterations: int, tolerance: float = 0.0) -> Centres:
    """Lloyd's iterations from given centres. Each pass adds up (count, sum, cost) per cluster inside
    the task and moves only those k small rows; an empty cluster keeps its centre."""
    centres, cost = start.values.copy(), None
    k, dim = centres.shape
    schema = "cluster int, n long, cost double, s array<double>"
    arrow = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), ("s", pa.list_(pa.float64()))])
    for _ in range(iterations):
        now = centres

        def partial(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            n, s, c = np.zeros(k, dtype=np.int64), np.zeros((k, dim)), np.zeros(k)
            for b in batches:
                x = matrix(b.column(0), dim)
                if not len(x):
                    continue
                best, d1, _ = _nearest_two(x, now)
                for j in np.unique(best):
                    hit = best == j
                    n[j] += hit.sum()
                    s[j] += x[hit].sum(axis=0)
                    c[j] += (d1[hit] ** 2).sum()
            yield pa.RecordBatch.from_pydict({"cluster": list(range(k)), "n": n, "cost": c, "s": s.tolist()}, schema=arrow)

        sums = df.select(vec).mapInArrow(partial, schema).groupBy("cluster").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")
        )
        rows = sums.collect()  # k rows
        moved = now.copy()
        for r in rows:
            if r["n"]:
                moved[r["cluster"]] = np.array(r["s"]) / r["n"]
        cost = float(sum(r["cost"] for r in rows))
        shift = float(np.abs(moved - now).max())
        centres = moved
        if shift <= tolerance:
            break
    return Centres(centres, cost)


def fit_kmeans(train: DataFrame, vec: str, k: int, seed: int, n_init: int = 10, max_iter: int = 300, key: str | None = None) -> Centres:
    """k-means with restarts that share their scans; the fit with the lowest cost wins, the earliest on ties. Draws go by `key`, or by the place of a row."""
    from . import manyfits as M

    data = M.prepared(train, key, vec).persist()
    try:
        return M.restarts(data, [M.Fit(k, seed)], n_init, max_iter)[0]
    finally:
        data.unpersist()


def _log_density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, chol: list[np.ndarray]) -> np.ndarray:
    """log(weight * density) of every row under every component, (n, k)."""
    out = np.empty((len(x), len(mu)))
    for j, c in enumerate(chol):
        z = np.linalg.solve(c, (x - mu[j]).T)
        out[:, j] = np.log(w[j]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(c)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def fit_gmm(
    train: DataFrame, vec: str, k: int, seed: int, n_init: int = 1, max_iter: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6, key: str | None = None
) -> Mixture:
    """Full-covariance Gaussian mixture by expectation maximisation from k-means starts that share their scans, with `ridge` added to every covariance diagonal (a component
    without rows then stays finite). Stops when the mean log likelihood moves less than the tolerance; the start with the highest one wins."""
    from . import manyfits as M

    data = M.prepared(train, key, vec).persist()
    try:
        found = M.mixtures(data, [M.Fit(k, seed + i) for i in range(n_init)], max_iter, tolerance, ridge)
        return max(found, key=lambda m: m.log_likelihood)
    finally:
        data.unpersist()


def predict_gmm(df: DataFrame, vec: str, mix: Mixture, keep: Sequence[str]) -> DataFrame:
    """cluster, its posterior (`confidence`) and the row's log likelihood."""
    w, mu = mix.weights, mix.means
    dim = mu.shape[1]
    chol = [np.linalg.cholesky(c) for c in mix.covs]
    kind = [pa.field("cluster", pa.int32()), pa.field("confidence", pa.float64()), pa.field("log_lik", pa.float64())]

    @F.arrow_udf("struct<cluster:int,confidence:double,log_lik:double>")
    def score(col: pa.Array) -> pa.Array:
        logp = _log_density(matrix(col, dim), w, mu, chol)
        top = logp.max(axis=1)
        lse = top + np.log(np.exp(logp - top[:, None]).sum(axis=1))
        arrays = [pa.array(logp.argmax(axis=1).astype(np.int32)), pa.array(np.exp(top - lse)), pa.array(lse)]
        return pa.StructArray.from_arrays(arrays, fields=kind)

    return df.withColumn("_s", score(F.col(vec))).select(
        *keep, F.col("_s.cluster").cast("bigint").alias("cluster"), F.col("_s.confidence").alias("confidence"),
        F.col("_s.log_lik").alias("log_lik"),
    )


def silhouette_rows(df: DataFrame, key: str, vec: str, cluster: str, rows_per_tile: int = 32_768, tiles: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette per row: (key, cluster, s). Work is quadratic; pairs stay inside matrix products of `STRIP` rows and never become rows. A row is
    copied once per tile, so tiles are large; small tables still make up to `TILES` squared tasks."""
    data = df.select(key, vec, F.col(cluster).alias("_c"))
    tiles = tiles or max(tile_count(data, rows_per_tile), min(tile_count(data, 2048), TILES))
    kind = dict(data.dtypes)[key]

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: a[key][:0], "own": [], "other": [], "s": [], "n": []})
        x, y = np.stack(a[vec]).astype(float), np.stack(b["_v"]).astype(float)
        names, code = np.unique(b["_other"].to_numpy(), return_inverse=True)
        total = np.zeros((len(x), len(names)))
        member = np.eye(len(names))[code]
        for i in range(0, len(x), STRIP):
            for j in range(0, len(y), STRIP):
                total[i:i + STRIP] += distances(x[i:i + STRIP], y[j:j + STRIP]) @ member[j:j + STRIP]
        n = np.bincount(code)
        return pd.concat([pd.DataFrame({key: a[key], "own": a["_c"], "other": c, "s": total[:, k], "n": n[k]}) for k, c in enumerate(names)])

    right = data.select(F.col(key).alias("_k"), F.col(vec).alias("_v"), F.col("_c").alias("_other"))
    parts = reduce_tiles(data, right, key, "_k", tiles, sums, f"{key} {kind}, own long, other long, s double, n long")
    per = parts.groupBy(key, "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("other")
    agg = per.groupBy(key, "own").agg(
        F.max(F.when(mine, F.col("n"))).alias("size"),
        F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("size") == 1, 0.0).when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return agg.select(key, F.col("own").alias(cluster), F.when(F.col("b").isNotNull(), s).alias("s"))


def silhouette(df: DataFrame, key: str, vec: str, cluster: str, max_rows: int | None = None, seed: int = 0, fill: float | None = None, **kw) -> DataFrame:
    """Mean silhouette of all rows, or of max_rows fixed ones where the caller asks for a sample; one cluster
    only gives `fill` (NULL)."""
    from .sampling import subsample

    data = df if max_rows is None else subsample(df, key, max_rows, seed)
    return silhouette_rows(data, key, vec, cluster, **kw).agg(
        F.coalesce(F.avg("s"), F.lit(fill).cast("double")).alias("silhouette"), F.count(F.lit(1)).alias("n")
    )


def cluster_counts(labels: DataFrame, k: int, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Counts and fractions of clusters 0..k-1, empty ones included, from one aggregate per group."""
    known = F.col(cluster).isNull() | F.col(cluster).between(0, k - 1)
    told = F.when(known, F.col(cluster)).otherwise(F.raise_error(F.concat(F.lit("cluster outside 0..k-1: "), F.col(cluster).cast("string"))).cast(labels.schema[cluster].dataType))
    agg = labels.withColumn(cluster, told).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"), F.array(*[F.count_if(F.col(cluster) == j) for j in range(k)]).alias("_n")
    )
    return agg.select(*by, "n_all", F.posexplode("_n").alias(cluster, "n")).withColumn(
        "fraction", F.col("n") / F.nullif(F.col("n_all"), F.lit(0))
    )


def occupancy(labels: DataFrame, k: int, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Smallest cluster fraction and number of empty clusters among k."""
    return cluster_counts(labels, k, cluster, by).groupBy(*by).agg(
        F.min("fraction").alias("min_cluster_fraction"), F.count_if(F.col("n") == 0).alias("empty_clusters")
    )


def selection_score(sil: Column, stability: Column, min_fraction: Column, empty: Column) -> Column:
    """0.60 silhouette + 0.30 stability + 0.10 occupancy (full from 5 %) - 1 with empty clusters."""
    fill = F.least(min_fraction / 0.05, F.lit(1.0))
    return 0.60 * sil + 0.30 * stability + 0.10 * fill - F.when(empty > 0, 1.0).otherwise(0.0)


def aggregate_candidates(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, population std and max of each metric over seeds, by (method, k)."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.max(m).alias(f"{m}_max")]
    return results.groupBy("method", "k").agg(F.count(F.lit(1)).alias("n_fits"), *aggs)


def select_best(candidates: DataFrame, score: str = "score", sil: str = "silhouette", stability: str = "stability") -> DataFrame:
    """Highest score, then silhouette, then stability, then smaller k, then kmeans before gmm."""
    method = F.when(F.col("method") == "kmeans", 0).otherwise(1)
    return candidates.orderBy(F.desc(score), F.desc(sil), F.desc(stability), F.asc("k"), method).limit(1)


def seed_summary(pairs: DataFrame, metric: str = "ari") -> DataFrame:
    """Mean and population std of a pairwise metric."""
    return pairs.agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"))


def frozen_table(spark: SparkSession, centres: Centres) -> DataFrame:
    """Centres as a parameter table (cluster, centre)."""
    rows = [(j, [float(v) for v in c]) for j, c in enumerate(centres.values)]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def from_frozen(table: DataFrame) -> Centres:
    rows = sorted(table.select("cluster", "centre").collect())
    return Centres(np.array([r[1] for r in rows]))
