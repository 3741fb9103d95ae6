"""Masked views of model inputs, drawn from hashes of (seed, row), and their change statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.ordering import quantiles

CHANNELS = ("sin_angle", "cos_angle", "speed")


@dataclass(frozen=True)
class ViewConfig:
    temporal_probability: float = 0.50
    temporal_fraction: float = 0.10
    feature_probability: float = 0.25
    orientation: bool = True
    speed: bool = True
    mask_value: float = 0.0


def view_seed(seed: int, epoch: int, row: Column, validation: bool = False) -> Column:
    """Seed of a row's views: training and validation never share one."""
    return F.lit(seed + epoch * 1000003 + (50_000_000 if validation else 0)).cast("bigint") + row * 97


def mask_span(length: Column, seed: Column, view: str, fraction: float) -> tuple[Column, Column]:
    """Start and length of one block of 1..floor(length * fraction) samples; length 0 if none fits."""
    top = F.floor(length * F.lit(fraction)).cast("int")
    size = F.when(top > 0, 1 + F.pmod(H.draw(seed, F.lit(view), F.lit("len")), top)).otherwise(0).cast("int")
    start = F.pmod(H.draw(seed, F.lit(view), F.lit("start")), length - size + 1).cast("int")
    return start, size


def temporal_mask(a: Column, start: Column, size: Column, value: float = 0.0) -> Column:
    """The block [start, start+size) of the series set to the mask value."""
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + size), F.lit(value).cast("float")).otherwise(x))


def feature_mask(a: Column, value: float = 0.0) -> Column:
    """The whole channel set to the mask value."""
    return F.transform(a, lambda x: F.lit(value).cast("float"))


def masked_view(df: DataFrame, seed: Column, view: str, config: ViewConfig = ViewConfig(), channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One view: columns <channel>_<view> plus the choices <view>_start, <view>_size (0 = no block) and
    <view>_group (NULL, orientation or speed)."""
    length = F.size(channels[0])
    start, size = mask_span(length, seed, view, config.temporal_fraction)
    use_block = H.uniform(seed, F.lit(view), F.lit("block")) < config.temporal_probability
    groups = [g for g, on in (("orientation", config.orientation), ("speed", config.speed)) if on]
    pick = F.element_at(F.array(*[F.lit(g) for g in groups]), (F.pmod(H.draw(seed, F.lit(view), F.lit("group")), F.lit(len(groups))) + 1).cast("int"))
    use_group = H.uniform(seed, F.lit(view), F.lit("mask")) < config.feature_probability
    s = df.withColumns({
        f"{view}_start": start, f"{view}_size": F.when(use_block, size).otherwise(0), f"{view}_group": F.when(use_group, pick),
    })
    out = {}
    for c in channels:
        group = "speed" if c == channels[-1] else "orientation"
        timed = temporal_mask(F.col(c), F.col(f"{view}_start"), F.col(f"{view}_size"), config.mask_value)
        out[f"{c}_{view}"] = F.when(F.coalesce(F.col(f"{view}_group") == group, F.lit(False)), feature_mask(F.col(c), config.mask_value)).otherwise(timed)
    return s.withColumns(out)


def two_views(df: DataFrame, seed: Column, config: ViewConfig = ViewConfig()) -> DataFrame:
    """Views a and b from independent draws of the same row seed."""
    return masked_view(masked_view(df, seed, "a", config), seed, "b", config)


def view_metrics(df: DataFrame, ids: Sequence[str], view: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Per bout: changed elements and steps (count, fraction), mean and largest absolute change."""
    changes = [F.zip_with(c, f"{c}_{view}", lambda x, y: F.abs(x.cast("double") - y.cast("double"))) for c in channels]
    s = df.select(*ids, F.size(channels[0]).alias("_t"), *[d.alias(f"_d{i}") for i, d in enumerate(changes)])
    n = len(channels)
    count = lambda a: F.size(F.filter(a, lambda x: x != 0))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    steps = F.size(F.filter(F.arrays_zip(*[f"_d{i}" for i in range(n)]), lambda z: sum((F.when(z[f"_d{i}"] != 0, 1).otherwise(0) for i in range(1, n)), F.when(z["_d0"] != 0, 1).otherwise(0)) > 0))
    elements = sum((count(F.col(f"_d{i}")) for i in range(1, n)), count(F.col("_d0")))
    total = sum((add(F.col(f"_d{i}")) for i in range(1, n)), add(F.col("_d0")))
    size = F.col("_t") * n
    return s.select(
        *ids, elements.cast("bigint").alias("changed_elements"), (elements / size).alias("changed_element_fraction"), steps.cast("bigint").alias("changed_steps"),
        (steps / F.col("_t")).alias("changed_step_fraction"), (total / size).alias("mean_abs_change"), F.greatest(*[F.array_max(f"_d{i}") for i in range(n)]).alias("max_abs_change"),
    )


def metric_distribution(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, min, p25, median, mean, p75, p95, max) over bouts."""
    long = metrics.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], [F.col(n) for n in names], "metric", "_v")
    g = long.groupBy("metric").agg(F.min("_v").alias("min"), F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    q = quantiles(long, ["metric"], "_v", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, few_keys=True)
    return g.join(q, "metric")
