"""Clustering candidates: all fitted in shared passes, scored on held-out rows, aggregated, chosen, refitted."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import manyfits as M
from ..operators.linear import fit_pca
from ..operators.sampling import subsample

SAMPLE = 20_000  # rows of a silhouette and of the repeated fits, as in the study
ONE_CLUSTER = -1.0  # silhouette of a candidate that puts all held-out rows into one cluster
STEP = 1009  # between the seeds of repeated fits


def fit_all(data: DataFrame, specs: Sequence[tuple[str, M.Fit]], n_init: int = 10) -> list[M.Model]:
    """One model per (method, fit) over `prepared` rows: all k-means restarts share their scans, and so do all mixtures (one start each)."""
    out: list[M.Model | None] = [None] * len(specs)
    for method in ("kmeans", "gmm"):
        at = [i for i, (m, _) in enumerate(specs) if m == method]
        if at:
            fits = [specs[i][1] for i in at]
            for i, model in zip(at, M.restarts(data, fits, n_init) if method == "kmeans" else M.mixtures(data, fits), strict=True):
                out[i] = model
    if any(m is None for m in out):
        raise ValueError("methods are kmeans and gmm")
    return out


def _repeated(specs: Sequence[tuple[str, int, int]], repeats: int, place: dict[int, int | None]) -> list[tuple[str, M.Fit]]:
    return [(m, M.Fit(k, s + STEP * i, place[s])) for m, k, s in specs for i in range(repeats)]


def _agreement(data: DataFrame, models: Sequence[M.Model], specs: Sequence[tuple[str, int, int]], repeats: int, place: dict[int, int | None]) -> list[float]:
    """Mean pairwise ARI of each candidate's repeats."""
    pairs = [(models[c * repeats + a], models[c * repeats + b]) for c in range(len(specs)) for a, b in combinations(range(repeats), 2)]
    if not pairs:
        return [float("nan")] * len(specs)
    tables = M.crossings(data, pairs, [place[s] for _, _, s in specs for _ in combinations(range(repeats), 2)])
    per = len(tables) // len(specs)
    return [float(np.mean([M.adjusted_rand(t) for t in tables[c * per:(c + 1) * per]])) for c in range(len(specs))]


def stabilities(train: DataFrame, key: str, vec: str, specs: Sequence[tuple[str, int, int]], repeats: int, max_rows: int | None, n_init: int = 10) -> list[float]:
    """Mean pairwise ARI of repeated fits (seed + 1009 i) for every (method, k, seed). All repeats of all of them share their scans, over one fixed subsample of at most
    max_rows rows a seed."""
    rows = train.select(key, vec)
    seeds = sorted({s for _, _, s in specs})
    place: dict[int, int | None] = dict.fromkeys(seeds)
    if max_rows is not None and rows.count() > max_rows:
        # a row comes once for each seed that drew it
        place = {s: i for i, s in enumerate(seeds)}
        parts = [subsample(rows, key, max_rows, s).withColumn("_w", F.array(*[F.lit(float(s == t)) for t in seeds])) for s in seeds]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    data = M.prepared(rows, key, vec, "_w" if "_w" in rows.columns else None).persist()
    try:
        return _agreement(data, fit_all(data, _repeated(specs, repeats, place), n_init), specs, repeats, place)
    finally:
        data.unpersist()


def fit_stability(train: DataFrame, key: str, vec: str, method: str, k: int, seed: int, repeats: int, max_rows: int | None, n_init: int = 10) -> DataFrame:
    """`stabilities` of one candidate: one row (stability)."""
    value = stabilities(train, key, vec, [(method, k, seed)], repeats, max_rows, n_init)[0]
    return train.sparkSession.createDataFrame([(value,)], "stability double")


def _silhouettes(held: DataFrame, key: str, vec: str, models: Sequence[M.Model], seeds: Sequence[int], max_rows: int) -> list[float]:
    """Silhouette of every model over all rows, or where they are more than max_rows over the subsample of its seed."""
    def measured(rows: DataFrame, at: Sequence[int]) -> list[float]:
        data = M.prepared(rows, key, vec).persist()
        try:
            return M.silhouettes(data, [models[i] for i in at], max_rows).tolist()
        finally:
            data.unpersist()

    if held.count() <= max_rows:
        return measured(held, range(len(models)))
    out = [0.0] * len(models)
    for s in sorted(set(seeds)):
        at = [i for i, t in enumerate(seeds) if t == s]
        for i, v in zip(at, measured(subsample(held, key, max_rows, s), at), strict=True):
            out[i] = v
    return out


def candidates(
    train: DataFrame, held: DataFrame, key: str, vec: str, methods: Sequence[str], ks: Sequence[int], seeds: Sequence[int],
    n_init: int = 10, silhouette_rows: int = SAMPLE, stability_rows: int | None = SAMPLE, repeats: int = 3,
) -> DataFrame:
    """One row per (method, k, seed): rows of train and of held counted over the clusters, the largest distance of a k-means centre from the mean of its training rows (0 for a
    mixture), silhouette, stability, smallest fraction, empty clusters and score. The number of scans doesn't grow with the number of candidates. Where the repeats take all training rows,
    a candidate's own fit is its first repeat, and all share their scans."""
    specs = [(m, k, s) for m in methods for k in ks for s in seeds]
    data = M.prepared(train, key, vec).persist()
    rows = held.select(key, vec).persist()
    try:
        whole = repeats > 0 and (stability_rows is None or data.count() <= stability_rows)
        place = dict.fromkeys(s for _, _, s in specs)
        if whole:
            found = fit_all(data, _repeated(specs, repeats, place), n_init)
            models, stab = found[::repeats], _agreement(data, found, specs, repeats, place)
        else:
            models = fit_all(data, [(m, M.Fit(k, s)) for m, k, s in specs], n_init)
        fitted = M.counts(data, models)
        hard = [i for i, (m, _, _) in enumerate(specs) if m == "kmeans"]
        off = [0.0] * len(specs)
        if hard:
            centres = [models[i].values for i in hard]
            sums, n, _ = M.moments(data, centres[0].shape[1], [M.Fit(len(c), 0) for c in centres], centres)
            for i, c, s, w in zip(hard, centres, sums, n, strict=True):
                used = w > 0
                off[i] = float(np.abs(s[used] / w[used, None] - c[used]).max())
        seen = M.counts(M.prepared(rows, key, vec), models)
        sil = _silhouettes(rows, key, vec, models, [s for _, _, s in specs], silhouette_rows)
    finally:
        data.unpersist()
        rows.unpersist()
    if not whole:
        stab = stabilities(train, key, vec, specs, repeats, stability_rows, n_init)
    out = []
    for i, (m, k, s) in enumerate(specs):
        total = int(seen[i].sum())
        empty = k - int((seen[i] > 0).sum())
        least = 0.0 if empty or not total else float(seen[i].min() / total)
        out.append((m, k, s, int(fitted[i].sum()), total, off[i], ONE_CLUSTER if np.isnan(sil[i]) else sil[i], stab[i], least, empty))
    table = train.sparkSession.createDataFrame(
        out, "method string, k long, seed long, n_train long, n_held long, centre_gap double, silhouette double, stability double, min_cluster_fraction double, empty_clusters long")
    scored = C.selection_score(F.col("silhouette"), F.col("stability"), F.col("min_cluster_fraction"), F.col("empty_clusters"))
    return table.withColumn("score", scored)


def projected(train: DataFrame, held: DataFrame, key: str, vec: str, variance: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Both tables as (key, pc) in the training rows' principal components."""
    model = fit_pca(train, vec, variance)
    return tuple(model.project(t.select(key, vec), vec).select(key, "pc") for t in (train, held))


def sweep(spark: SparkSession, train: DataFrame, held: DataFrame, key: str, vec: str, variance: float = 0.95, **kw) -> DataFrame:
    """Training-fitted PCA, all candidates, means over seeds, candidates in order of preference."""
    a, b = projected(train, held, key, vec, variance)
    g = C.aggregate_candidates(candidates(a, b, key, "pc", **kw), ["score", "silhouette", "stability"])
    return g.select("method", "k", "n_fits", F.col("score_mean").alias("score"), "score_std", F.col("silhouette_mean").alias("silhouette"), F.col("stability_mean").alias("stability"))


def refit(train: DataFrame, validation: DataFrame, test: DataFrame, key: str, vec: str, method: str, k: int, seed: int, n_init: int = 10, silhouette_rows: int = SAMPLE) -> DataFrame:
    """The chosen model fitted on train and validation, scored once on test: one row."""
    data = M.prepared(train.unionByName(validation), key, vec).persist()
    try:
        model = fit_all(data, [(method, M.Fit(k, seed))], n_init)[0]
    finally:
        data.unpersist()
    if isinstance(model, C.Centres):
        lab = C.assign(test, vec, model, [key, vec], margins=True)
        conf = lab.agg(C.margin().alias("confidence"), F.lit(None).cast("double").alias("log_lik"), F.count("*").alias("n"))
    else:
        lab = C.predict_gmm(test, vec, model, [key, vec])
        conf = lab.agg(F.avg("confidence").alias("confidence"), F.avg("log_lik").alias("log_lik"), F.count("*").alias("n"))
    occ = C.occupancy(lab, k)
    sil = _silhouettes(test, key, vec, [model], [seed], silhouette_rows)[0]
    return conf.select(
        F.lit(method).alias("method"), F.lit(k).cast("bigint").alias("k"), "n", "confidence", "log_lik", F.lit(None if np.isnan(sil) else sil).cast("double").alias("silhouette"),
        occ.select("min_cluster_fraction").scalar().alias("min_cluster_fraction"), occ.select("empty_clusters").scalar().alias("empty_clusters"),
    )
