"""Deterministic subsamples and unit-level splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.ordering import first_rows, row_numbers


def subsample(df: DataFrame, key: str, max_rows: int, seed: int) -> DataFrame:
    """At most max_rows rows without replacement, the same on every run."""
    return first_rows(df, H.digest(seed, key), max_rows, [key])


def subsample_per_class(df: DataFrame, key: str, by: str, max_rows: int, seed: int) -> DataFrame:
    """At most max_rows rows of each class."""
    d = df.withColumn("_d", H.digest(seed, key))
    out = row_numbers(d, [by], ["_d", key], H.bucket(F.col("_d")), "_rn")
    return out.where(F.col("_rn") <= max_rows).drop("_d", "_rn")


def _ranked(df: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    d = df.withColumn("_d", H.digest(seed, key))
    return row_numbers(d, [by], ["_d", key], H.bucket(F.col("_d")), "_rn").join(sizes, by)


def unit_split(
    units: DataFrame, unit: str, family: str, seed: int, val_share: float = 0.15, test_share: float = 0.15, strict: bool = True
) -> DataFrame:
    """Units of each family in a fixed random order: train first, then validation, then test. Shares
    are rounded half to even with at least one unit each; a family below three units is an error."""
    val = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(val_share)).cast("bigint"))
    test = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(test_share)).cast("bigint"))
    rn, n = F.col("_rn"), F.col("_size")
    part = F.when(rn <= n - val - test, "train").when(rn <= n - test, "validation").otherwise("test")
    if strict:
        part = F.when(n < 3, F.raise_error(F.lit("a family needs at least three units"))).otherwise(part)
    return _ranked(units, unit, family, seed).select(*units.columns, part.alias("partition"))


def class_holdout(rows: DataFrame, key: str, by: str, seed: int, train_share: float = 0.8, min_rows: int = 4) -> DataFrame:
    """Within each class of at least min_rows rows, the first `train_share` (rounded down, at least one
    row, never all) trains and the rest has `held_out` true. Smaller classes are left out."""
    n = F.col("_size")
    train = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(train_share))), n - 1)
    out = _ranked(rows, key, by, seed).where(n >= min_rows)
    return out.select(*rows.columns, (F.col("_rn") > train).alias("held_out"))


def inherit_partition(bouts: DataFrame, split: DataFrame, key: str = "fish_id") -> DataFrame:
    """Every bout takes the partition of its unit; the optimiser broadcasts the split when it is small."""
    return bouts.join(split.select(key, "partition"), key)


def hash_partition(key: Column | str, seed: int | str, shares: Sequence[tuple[str, float]]) -> Column:
    """Partition name by cumulative share of a hash draw, for data without a frozen split."""
    u = H.uniform(seed, key)
    upto, out = 0.0, None
    for name, share in shares[:-1]:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(shares[-1][0])
