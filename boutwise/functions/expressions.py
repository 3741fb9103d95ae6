"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery: parameters reach every task without a join."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()


def ratio(a: Column, b: Column) -> Column:
    """a/b as double, NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pairs(n: Column) -> Column:
    """Number of unordered pairs among n items."""
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for bound, label in steps:
        cond = value >= bound
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long with one Expand, no shuffle."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in values], name, value)
