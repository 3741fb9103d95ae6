"""Effect sizes, group summaries, cluster profiles and rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.expressions import clip01
from ..functions.ordering import quantiles
from ..functions.positions import value_steps
from .clustering import cluster_counts


def finite(c: str) -> Column:
    """The value, or NULL where it is missing or not finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def group_moments(df: DataFrame, cluster: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, feature, n, mean, var): all features in one aggregate, unpivoted afterwards."""
    aggs = [
        F.struct(F.count(finite(f)).alias("n"), F.avg(finite(f)).alias("mean"), F.var_pop(finite(f)).alias("var")).alias(f"_f{i}")
        for i, f in enumerate(features)
    ]
    g = df.groupBy(*by, cluster).agg(*aggs)
    cells = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"_f{i}.{p}").alias(p) for p in ("n", "mean", "var")])
        for i, f in enumerate(features)
    ]
    return g.select(*by, cluster, F.inline(F.array(*cells))).where(F.col("n") > 0)


def effect_sizes(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Eta squared (0 without spread) and (max - min of cluster means)/overall std, from the group
    moments alone."""
    key = [*by, "feature"]
    n = F.col("n").cast("double")
    tot = moments.groupBy(*key).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("_m"))
    j = moments.join(tot, key)
    between = F.sum(n * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m")))
    inside = F.sum(n * F.col("var"))
    g = j.groupBy(*key).agg(
        F.sum("n").alias("n"), between.alias("_b"), inside.alias("_w"), (F.max("mean") - F.min("mean")).alias("_range")
    )
    sst = F.col("_b") + F.col("_w")
    return g.select(
        *key, "n", F.when(sst > 0, F.col("_b") / F.nullif(sst, F.lit(0.0))).otherwise(0.0).alias("eta_squared"),
        F.when(sst > 0, F.col("_range") / F.sqrt(F.nullif(sst, F.lit(0.0)) / F.col("n"))).otherwise(0.0).alias("standardized_mean_range"),
    )


GROUP_PROBS = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def group_summary(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Per cluster: count, fraction, mean, std, min, max, exact quantiles and IQR."""
    rows = df.select(F.col(cluster), finite(value).alias("_v")).where(F.col("_v").isNotNull())
    g = rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    q = quantiles(rows, [cluster], "_v", GROUP_PROBS, few_keys=True)
    total = g.agg(F.sum("n")).scalar()
    return g.join(q, cluster).select(
        cluster, "n", (F.col("n") / total).alias("fraction"), "mean", "std", "min", "max", *GROUP_PROBS, (F.col("p75") - F.col("p25")).alias("iqr")
    )


def profiles(df: DataFrame, cluster: str, features: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median of each feature over clusters 0..k-1: (by, feature, cluster, n, mean, median),
    NULL in an empty cluster."""
    m = group_moments(df, cluster, features, by)
    long = df.select(*by, cluster, *[finite(f).alias(f) for f in features]).unpivot(
        [*[F.col(b) for b in by], F.col(cluster)], [F.col(f) for f in features], "feature", "_v"
    )
    med = quantiles(long, [*by, "feature", cluster], "_v", {"median": 0.5}, few_keys=True)
    grid = m.select(*by, "feature").distinct().select(
        *by, "feature", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias(cluster)
    )
    key = [*by, "feature", cluster]
    return grid.join(m.select(*key, "n", "mean").join(med, key), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_features(effects: DataFrame, by: Sequence[str] = (), metric: str = "eta_squared") -> DataFrame:
    """Features ordered by the metric within `by`; feature lists are short."""
    w = Window.partitionBy(*by).orderBy(F.desc(metric), F.asc("feature"))
    return effects.withColumn("rank", F.row_number().over(w).cast("bigint"))


def rank_across_seeds(effects: DataFrame, primary: str, secondary: str, name: str = "feature") -> DataFrame:
    """Mean, std, min, max over seeds of two metrics per variable, ranked by the primary mean."""
    aggs = [F.count(F.lit(1)).alias("seed_count")]
    for m in (primary, secondary):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    g = effects.groupBy(name).agg(*aggs)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(f"{primary}_mean"), F.asc(name))
    return g.withColumn("rank", F.row_number().over(w).cast("bigint"))


def categorical_effects(df: DataFrame, cluster: str, columns: Sequence[str], by: Sequence[str] = (), missing: str = "__MISSING__") -> DataFrame:
    """NMI and Cramer's V of several text columns with the clusters: (by, feature, categories, nmi,
    cramers_v); missing text is dropped and a single category gives zeros."""
    from .agreement import contingency, cramers_v, measures

    long = df.select(*by, cluster, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [*[F.col(b) for b in by], F.col(cluster)], [F.col(c) for c in columns], "feature", "category"
    )
    long = long.where(F.col("category").isNotNull() & ~F.col("category").isin("", missing))
    key = [*by, "feature"]
    ct = contingency(long, "category", cluster, key)
    m = measures(ct, "category", cluster, key).select(*key, F.col("n_a").alias("categories"), "nmi")
    v = cramers_v(ct, "category", cluster, key).select(*key, "cramers_v")
    j = m.join(v, key)
    many = F.col("categories") > 1
    return j.select(*key, "categories", F.when(many, F.col("nmi")).otherwise(0.0).alias("nmi"), F.when(many, F.col("cramers_v")).otherwise(0.0).alias("cramers_v"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman rho of short profiles (k points per group) with average ranks; NULL below three points
    or for a constant side: (by, rho, n). Without groups the columns can be of any length."""
    if not by:
        return ranked_correlation(df, x, y)
    keys = list(by)
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())

    def avg_rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / 2.0

    ranked = rows.select(*keys, avg_rank("_x").alias("_rx"), avg_rank("_y").alias("_ry"))
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy")
    )
    ok = (F.col("n") >= 3) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    rho = F.when(ok, F.col("_c") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0)))
    return g.select(*by, rho.alias("rho"), "n")


def ranked_correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman rho of columns of any length: ranks come from a sample sort of value counts, so no task sorts a
    whole column. (by, rho, n)."""
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())

    def ranks(c: str) -> DataFrame:
        s = value_steps(rows, by, c)
        return s.select(*by, c, (F.col("below") + (F.col("c_all") + 1) / 2.0).alias(f"{c}_r"))

    j = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("w")).join(ranks("_x"), [*by, "_x"]).join(ranks("_y"), [*by, "_y"])
    w, a, b = F.col("w").cast("double"), F.col("_x_r"), F.col("_y_r")
    g = j.groupBy(*by).agg(
        F.sum("w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n").cast("double")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    rho = F.when((n >= 3) & (va > 0) & (vb > 0), cov / F.sqrt(F.nullif(va * vb, F.lit(0.0))))
    return g.select(*by, rho.alias("rho"), "n")


def profile_pairs(prof: DataFrame, seeds: Sequence[int], value: str, cluster: str = "cluster", seed: str = "seed") -> DataFrame:
    """Spearman between the profiles of every pair of seeds: (feature, seed_a, seed_b, rho, n)."""
    picks = [F.max(F.when(F.col(seed) == s, F.col(value))) for s in seeds]
    wide = prof.groupBy("feature", cluster).agg(F.array(*picks).alias("_v"))
    cells = [
        F.struct(F.lit(a).cast("bigint").alias("seed_a"), F.lit(b).cast("bigint").alias("seed_b"), F.col("_v")[i].alias("_p"), F.col("_v")[j].alias("_q"))
        for i, a in enumerate(seeds) for j, b in enumerate(seeds) if i < j
    ]
    long = wide.select("feature", F.inline(F.array(*cells)))
    return spearman(long, "_p", "_q", ["feature", "seed_a", "seed_b"])


def profile_pair_summary(pairs: DataFrame) -> DataFrame:
    """Per feature: pairs, pairs with a value, mean, median, min, max rho. Pairs are few."""
    return pairs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("rho").alias("finite_pairs"), F.avg("rho").alias("mean_rho"),
        F.median("rho").alias("median_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"),
    )


def profile_reproducibility(train: DataFrame, held: DataFrame, value: str = "mean", by: Sequence[str] = ("seed", "feature"), cluster: str = "cluster") -> DataFrame:
    """Spearman of each training profile with the held-out one: (by, rho, n)."""
    a = train.select(*by, cluster, F.col(value).alias("_a"))
    b = held.select(*by, cluster, F.col(value).alias("_b"))
    return spearman(a.join(b, [*by, cluster]), "_a", "_b", list(by))


def axis_summary(pair_summary: DataFrame, reproducibility: DataFrame, axes: dict[str, Sequence[str]]) -> DataFrame:
    """Named groups of features with their cross-seed rho and the mean training-to-held-out rho."""
    member = None
    for name, feats in axes.items():
        c = F.col("feature").isin(list(feats))
        member = F.when(c, name) if member is None else member.when(c, name)
    rep = reproducibility.groupBy("feature").agg(F.avg("rho").alias("train_held_rho"))
    out = pair_summary.withColumn("axis", member).where(F.col("axis").isNotNull())
    return out.join(rep, "feature", "left").select("axis", "feature", "mean_rho", "min_rho", "train_held_rho")


def directional_consistency(df: DataFrame, cluster: str = "cluster", direction: str = "direction") -> DataFrame:
    """Counts of directions over seeds per cluster, the mode (positive before negative before neutral)
    and its share of the non-missing ones; a cluster without any gives missing and 0."""
    names = ["positive", "negative", "neutral"]
    d = F.col(direction)
    g = df.groupBy(cluster).agg(
        *[F.count_if(d == n).alias(n) for n in names], F.count_if(d.isNull() | (d == "missing")).alias("missing")
    )
    top = F.greatest(*names)
    seen = sum((F.col(n) for n in names), F.lit(0))
    mode = F.when(seen == 0, "missing")
    for n in names:
        mode = mode.when(F.col(n) == top, n)
    share = F.when(seen > 0, top / F.nullif(seen, F.lit(0))).otherwise(0.0)
    return g.select(cluster, *names, "missing", mode.alias("modal_direction"), share.alias("consistency"))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square law, for the few rows of a result table."""
    import math

    def one(v: float, k: float) -> float:
        if v is None or math.isnan(v) or k <= 0:
            return float("nan")
        if v <= 0:
            return 1.0
        a, z = k / 2.0, v / 2.0
        front = math.exp(a * math.log(z) - z - math.lgamma(a))
        if z < a + 1:  # series for the lower tail
            term = total = 1.0 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= z / n
                total += term
            return max(0.0, 1.0 - front * total)
        b, c, d = z + 1 - a, 1e300, 1.0 / (z + 1 - a)  # continued fraction for the upper tail
        h = d
        for i in range(1, 10000):
            an = -i * (i - a)
            b += 2
            d = 1.0 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    return pd.Series([one(float(v), float(k)) for v, k in zip(x, dof)])


def kruskal_wallis(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """H with tie correction, degrees of freedom and p. Rows shrink to (value, cluster) counts, ranks
    come from a sample sort of the values."""
    steps = value_steps(df, [], value, parts=[cluster])
    rank = F.col("below") + (F.col("c_all") + 1) / 2.0
    per = steps.groupBy(cluster).agg(F.sum(F.col("_c") * rank).alias("_r"), F.sum("_c").alias("_n"), F.max("n_key").alias("_all"))
    n = F.col("_all").cast("double")
    h = per.groupBy().agg(
        F.max("_all").alias("n"), F.count(F.lit(1)).alias("groups"),
        (F.lit(12.0) / (F.max(n) * (F.max(n) + 1.0)) * F.sum(F.col("_r") * F.col("_r") / F.col("_n")) - 3.0 * (F.max(n) + 1.0)).alias("_h"),
    )
    # every distinct value once: its cells sum to c_all
    t = F.col("c_all").cast("double")
    ties = steps.agg(F.sum(F.col("_c") * (t * t - 1.0))).scalar()
    nn = F.col("n").cast("double")
    fix = 1.0 - ties / (nn * nn * nn - nn)
    out = h.select("n", "groups", (F.col("_h") / F.nullif(fix, F.lit(0.0))).alias("h"))
    return out.withColumn("p_value", chi2_tail(F.col("h"), F.col("groups") - 1))


ROBUST_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def robust_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, std, min, max and p01..p99 of one column."""
    rows = df.select(finite(value).alias("_v")).where(F.col("_v").isNotNull())
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    q = quantiles(rows, [], "_v", ROBUST_PROBS)
    packed = q.select(F.struct(*ROBUST_PROBS)).scalar()
    return g.withColumn("_q", packed).select("*", *[F.col("_q")[p].alias(p) for p in ROBUST_PROBS]).drop("_q")


def summarize(df: DataFrame, value: str = "value", by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean, std, min, max over seeds of tidy metrics."""
    return df.groupBy(*by).agg(
        F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"))


def substructure(df: DataFrame, cls: str, cluster: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """How each known class spreads over k clusters: occupied clusters, those with at least 5 % and
    10 %, dominant cluster (first on ties) and share, entropy over log k, exp-entropy number."""
    cells = cluster_counts(df, k, cluster, [*by, cls])
    f = F.col("fraction")
    h = -F.sum(F.when(f > 0, f * F.ln(f)).otherwise(0.0))
    g = cells.groupBy(*by, cls).agg(
        F.max("n_all").alias("n"), F.count_if(F.col("n") > 0).alias("occupied"), F.count_if(f >= 0.05).alias("at_least_5pct"),
        F.count_if(f >= 0.10).alias("at_least_10pct"), F.max(F.struct(F.col("n"), (-F.col(cluster)).alias("c"))).alias("_top"),
        F.max(f).alias("dominant_share"), h.alias("_h"),
    )
    return g.select(
        *by, cls, "n", "occupied", "at_least_5pct", "at_least_10pct", (-F.col("_top.c")).cast("bigint").alias("dominant_cluster"), "dominant_share",
        (F.col("_h") / F.lit(float(np.log(k)))).alias("normalized_entropy"), F.exp("_h").alias("effective_number"),
    )


def followup_score(effective: Column, ari: Column, js: Column) -> Column:
    """0.40 spread (effective clusters from 1 to 4) + 0.35 ARI + 0.25 JS similarity, each clipped to [0, 1]."""
    return 0.40 * clip01((effective - 1.0) / 3.0) + 0.35 * clip01(ari) + 0.25 * clip01(js)


BOX_PROBS = {"whisker_low": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "whisker_high": 0.95}


def box_stats(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Box-plot numbers per cluster with 5/95 % whiskers."""
    rows = df.select(cluster, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    return quantiles(rows, [cluster], "_v", BOX_PROBS, few_keys=True)
