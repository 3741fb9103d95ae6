"""Scaling fitted on training rows only; parameters are small tables, applied as scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.expressions import one_row
from ..functions.ordering import quantiles
from .effects import finite


def require_train(df: DataFrame, partition: str = "partition", train: str = "train") -> DataFrame:
    """Fails the job on a row that is not a training row."""
    ok = F.when(F.col(partition) == train, F.lit(True)).otherwise(F.raise_error(F.lit("fit on non-training rows")).cast("boolean"))
    return df.where(ok)


def fit_scaler(train: DataFrame, features: Sequence[str], zero_is_error: bool = False) -> DataFrame:
    """Parameter table (feature, mean, scale): population std; zero or missing spread becomes 1, or an
    error. One aggregate over all features."""
    cells = [
        F.struct(F.lit(f).alias("feature"), F.avg(finite(f)).alias("mean"), F.stddev_pop(finite(f)).alias("_s")).alias(f"_{i}")
        for i, f in enumerate(features)
    ]
    out = train.agg(*cells).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    flat = F.col("_s").isNull() | (F.col("_s") == 0)
    bad = F.raise_error(F.concat(F.lit("no spread in "), F.col("feature"))).cast("double") if zero_is_error else F.lit(1.0)
    return out.select("feature", "mean", F.when(flat, bad).otherwise(F.col("_s")).alias("scale"))


def _lookup(params: DataFrame, value: str) -> Column:
    """The parameter column as a feature -> value map in one scalar subquery (one entry per feature)."""
    return params.agg(F.map_from_entries(F.collect_list(F.struct("feature", value)))).scalar()


def apply_scaler(df: DataFrame, features: Sequence[str], params: DataFrame) -> DataFrame:
    """z-scores of the features; other columns stay."""
    packed = params.agg(
        *[F.max(F.when(F.col("feature") == f, F.struct("mean", "scale"))).alias(f"p{i}") for i, f in enumerate(features)]
    )
    out = df.withColumn("_p", one_row(packed))
    z = {f: (F.col(f) - F.col("_p")[f"p{i}"]["mean"]) / F.col("_p")[f"p{i}"]["scale"] for i, f in enumerate(features)}
    return out.withColumns(z).drop("_p")


def fit_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact training medians (feature, median), missing values ignored."""
    long = train.select(*[finite(f).alias(f) for f in features]).unpivot([], [F.col(f) for f in features], "feature", "_v")
    return quantiles(long, ["feature"], "_v", {"median": 0.5}, few_keys=True)


def impute(df: DataFrame, features: Sequence[str], medians: DataFrame) -> DataFrame:
    """Missing or non-finite values replaced by the training median."""
    out = df.withColumn("_m", _lookup(medians, "median"))
    return out.withColumns({f: F.coalesce(finite(f), F.col("_m")[f]) for f in features}).drop("_m")


def fit_array_stats(train: DataFrame, array: str = "speed") -> DataFrame:
    """Count, mean and std of all samples of an array column: each row is reduced to its moments in
    place, then moments are added (n, mean, std). Nothing is exploded."""
    m = train.select(A.moments(F.col(array)).alias("m")).where(F.col("m.n") > 0)
    n, mean, m2 = F.col("m.n"), F.col("m.mean"), F.col("m.m2")
    g = m.agg(F.sum(n).alias("n"), F.sum(n * mean).alias("_s"), F.sum(m2 + n * mean * mean).alias("_q"))
    mu = F.col("_s") / F.col("n")
    return g.select(
        F.col("n").cast("bigint").alias("n"), mu.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - mu * mu, F.lit(0.0))).alias("std")
    )


def apply_array_stats(df: DataFrame, stats: DataFrame, array: str = "speed") -> DataFrame:
    """The array channel normalised; a zero std divides by 1."""
    s = one_row(stats)
    out = df.withColumns({"_mean": s["mean"], "_std": F.when(s["std"] > 0, s["std"]).otherwise(1.0)})
    return out.withColumn(array, F.transform(array, lambda x: (x - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def zscore_within(df: DataFrame, value: str, by: Sequence[str], out: str = "z") -> DataFrame:
    """z-score of a profile within its group (a seed's k clusters), std 0 -> 1."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when(s > 0, s).otherwise(1.0))
