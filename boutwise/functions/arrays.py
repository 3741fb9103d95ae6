"""Column builders over one bout's samples (array<double> columns), all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnitude(a: Column) -> Column:
    """Element-wise absolute value."""
    return F.transform(a, lambda x: F.abs(x))


def diff(a: Column) -> Column:
    """First difference; an array of fewer than two samples gives an empty array."""
    n = F.size(a)
    later = F.slice(a, 2, F.greatest(n - 1, F.lit(0)))
    earlier = F.slice(a, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda y, x: y - x)


def wrap_angle(d: Column) -> Column:
    """An angular difference folded to [-pi, pi]."""
    return F.atan2(F.sin(d), F.cos(d))


def wrapped_turns(heading: Column) -> Column:
    """Successive heading changes, each folded to [-pi, pi]."""
    return F.transform(diff(heading), wrap_angle)


def fold_step(d: Column) -> Column:
    """Phase-unwrapping step: d folded by whole turns, where an exact +pi stays +pi."""
    folded = F.pmod(d + F.lit(PI), F.lit(2 * PI)) - F.lit(PI)
    folded = F.when((folded == -PI) & (d > 0), F.lit(PI)).otherwise(folded)
    return F.when(F.abs(d) < PI, d).otherwise(folded)


def unwrapped_turns(heading: Column) -> Column:
    """Differences of the unwrapped heading."""
    return F.transform(diff(heading), fold_step)


def unwrap(heading: Column) -> Column:
    """Heading with whole-turn jumps removed: first sample plus the running sum of folded steps."""
    def push(acc: Column, step: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + step))

    return F.when(F.size(heading) == 0, heading).otherwise(
        F.aggregate(unwrapped_turns(heading), F.slice(heading, 1, 1), push)
    )


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def moments(a: Column) -> Column:
    """One pass over an array: struct(n, mean, m2, sq, top); m2 is the centred sum of squares."""
    start = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
        F.lit(0.0).alias("sq"), F.lit(None).cast("double").alias("top"),
    )

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1.0
        centre = s["mean"] + (x - s["mean"]) / n
        return F.struct(
            n.alias("n"), centre.alias("mean"),
            (s["m2"] + (x - s["mean"]) * (x - centre)).alias("m2"),
            (s["sq"] + x * x).alias("sq"), F.greatest(s["top"], x).alias("top"),
        )

    return F.aggregate(a, start, step)


def m_mean(m: Column) -> Column:
    return F.when(m["n"] > 0, m["mean"])


def m_std(m: Column) -> Column:
    """Population standard deviation from a moments struct."""
    return F.when(m["n"] > 0, F.sqrt(m["m2"] / m["n"]))


def m_rms(m: Column) -> Column:
    return F.when(m["n"] > 0, F.sqrt(m["sq"] / m["n"]))


def m_sum(m: Column) -> Column:
    return F.when(m["n"] > 0, m["mean"] * m["n"])


def sorted_quantile(s: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array, at position q*(n-1)."""
    pos = F.lit(float(q)) * (F.size(s) - 1)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a, b = F.element_at(s, lo + 1), F.element_at(s, hi + 1)
    return F.when(F.size(s) > 0, a + (b - a) * (pos - lo))


def resample(a: Column, length: int) -> Column:
    """Linear interpolation to `length` samples over the normalised phase; NULL below two samples."""
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        pos = i * last / F.lit(float(length - 1))
        lo = F.least(F.floor(pos).cast("int"), last - 1)
        x, y = F.element_at(a, lo + 1), F.element_at(a, lo + 2)
        return x + (y - x) * (pos - lo)

    out = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)
    return F.when(F.size(a) == length, a).when(F.size(a) >= 2, out)


def nonfinite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
