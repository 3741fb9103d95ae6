"""Path, turning and speed features of recordings of any length, from rows of samples.

A recording is cut into segments of at most `length` samples, one row with array columns each. A segment gets the sample before it from the full segment
before, so that every step belongs to exactly one segment, and is folded to a small summary (step count, mean, centred sum of squares, square sum, maximum). Summaries of
a recording are merged in order. No row holds more than `length` + 1 samples, and one long recording is spread over as many tasks as it has segments. Recordings
of at most `length` samples are one segment and need no merging. Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources.bouts import cut_bouts

SEGMENT = 1 << 14


def segments(samples: DataFrame, key: str, order: Sequence[str], slot: Column, fields: Sequence[str], length: int = SEGMENT) -> DataFrame:
    """(key, segment, offset, fields as arrays, _before): consecutive runs of `length` (two or more) samples. `slot` must not decrease along `order`; it
    splits the numbering of a very long key. `_before` is the sample before the segment, NULL in the first; `offset` the place of the segment's first sample."""
    if length < 2:
        raise ValueError("a segment has at least two samples")
    cut = cut_bouts(samples, key, order, slot, length, fields).withColumnRenamed("bout_index", "segment")
    # only full segments have another behind them, so short recordings send nothing
    edges = cut.where(F.size(fields[0]) == length).select(key, (F.col("segment") + 1).alias("segment"), F.struct(*[F.element_at(f, -1).alias(f) for f in fields]).alias("_before"))
    return cut.join(edges, [key, "segment"], "left").withColumn("offset", F.col("segment") * length)


def _with_before(field: str) -> Column:
    """The samples of a segment behind the one before it."""
    return F.when(F.col("_before").isNull(), F.col(field)).otherwise(F.concat(F.array(F.col("_before")[field]), F.col(field)))


def merged_moments(parts: Column) -> Column:
    """One moments struct from an array of those of disjoint parts, in array order."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "mean", "m2", "sq")], F.lit(None).cast("double").alias("top"))

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.coalesce(b["n"] / F.nullif(n, F.lit(0.0)), F.lit(0.0))
        return F.struct(
            n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
            (a["sq"] + b["sq"]).alias("sq"), F.greatest(a["top"], b["top"]).alias("top"),
        )

    return F.aggregate(parts, start, both)


def _merge(folded: DataFrame, key: str, names: Sequence[str], *more: Column) -> DataFrame:
    """Per key the merged moments of each named column, taken in segment order: one small struct per segment travels."""
    listed = folded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", *names))).alias("_all"), *more)
    return listed.withColumns({n: merged_moments(F.col(f"_all.{n}")) for n in names}).drop("_all")


def _steps(x: str = "x", y: str = "y") -> Column:
    return F.zip_with(A.diff(_with_before(x)), A.diff(_with_before(y)), lambda u, v: F.sqrt(u * u + v * v))


def path_features(segs: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Samples, net displacement, path length, mean and largest step of each recording; the last three are NULL below two samples."""
    folded = segs.select(key, "segment", F.size(x).alias("_n"), F.struct(F.element_at(x, 1).alias("x"), F.element_at(y, 1).alias("y")).alias("_first"),
                         F.struct(F.element_at(x, -1).alias("x"), F.element_at(y, -1).alias("y")).alias("_last"), A.moments(_steps(x, y)).alias("_m"))
    one = _merge(folded, key, ["_m"], F.sum("_n").alias("samples"), F.min_by("_first", "segment").alias("_a"), F.max_by("_last", "segment").alias("_b"))
    m = F.col("_m")
    net = F.sqrt(F.pow(F.col("_b.x") - F.col("_a.x"), 2) + F.pow(F.col("_b.y") - F.col("_a.y"), 2))
    return one.select(
        key, "samples", net.alias("head_net_displacement"), A.m_sum(m).alias("head_path_length"), A.m_mean(m).alias("head_mean_step"), m["top"].alias("head_max_step")
    )


def path_distance(segs: DataFrame, key: str, scale: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """(key, distance): travelled distance; 0 below two samples."""
    return path_features(segs, key, x, y).select(key, (F.coalesce("head_path_length", F.lit(0.0)) * scale).alias("distance"))


def turning_features(segs: DataFrame, key: str, heading: str = "heading") -> DataFrame:
    """Turning of the unwrapped heading: absolute and net sum, mean of the absolute turn, std of the signed turn, largest and root mean square; NULL below two samples."""
    turns = segs.select(key, "segment", A.unwrapped_turns(_with_before(heading)).alias("_t"))
    folded = turns.select(key, "segment", A.moments(F.col("_t")).alias("_m"), A.moments(A.magnitude(F.col("_t"))).alias("_am"))
    one, m, a = _merge(folded, key, ["_m", "_am"]), F.col("_m"), F.col("_am")
    return one.select(
        key, A.m_sum(a).alias("turn_total_abs"), A.m_sum(m).alias("turn_net"), A.m_mean(a).alias("turn_abs_mean"), A.m_std(m).alias("turn_std"), a["top"].alias("turn_max"),
        A.m_rms(m).alias("turn_rms"),
    )


def pointwise_speed(segs: DataFrame, key: str, factor: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, pos, v), one row per sample: step speed, where the first sample repeats the first step; a single sample has 0."""
    steps = F.transform(_steps(x, y), lambda s: s * factor)
    first = F.coalesce(F.get(F.col("_s"), F.lit(0)), F.lit(0.0))
    staged = segs.select(key, "offset", "_before", steps.alias("_s"))
    speeds = F.when(F.col("_before").isNull(), F.concat(F.array(first), F.col("_s"))).otherwise(F.col("_s"))
    return staged.select(key, "offset", F.posexplode(speeds).alias("_i", "v")).select(key, (F.col("offset") + F.col("_i")).alias("pos"), "v")


def resample(segs: DataFrame, key: str, field: str, points: int) -> DataFrame:
    """(key, j, v): linear interpolation at `points` places of the normalised length; recordings of one sample give no rows. A place goes to the segment that
    holds its upper neighbour, whose lower one is there as well or is the sample before."""
    # a recording of one segment knows its length; the others are at most samples / segment length
    many = segs.where("segment > 0").groupBy(key).agg(F.max(F.col("offset") + F.size(field) - 1).alias("_last"))
    rows = segs.join(F.broadcast(many), key, "left").withColumn("_top", F.coalesce("_last", F.size(field).cast("bigint") - 1)).where("_top > 0")
    rows = rows.select(key, "offset", "_top", F.size(field).alias("_n"), F.col("_before").isNull().alias("_starts"), _with_before(field).alias("_v"))

    def place(j: Column) -> Column:
        at = j * F.col("_top") / F.lit(float(points - 1))
        return F.struct(j.alias("j"), at.alias("_at"), (F.least(F.floor(at), F.col("_top") - 1) + 1).cast("bigint").alias("_upper"))

    # every segment makes its own places only, beside its samples
    every = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), place)
    rows = rows.withColumn("_want", F.filter(every, lambda w: (w["_upper"] >= F.col("offset")) & (w["_upper"] < F.col("offset") + F.col("_n"))))

    def value(w: Column) -> Column:
        place = (w["_upper"] - F.col("offset") + F.when(F.col("_starts"), 0).otherwise(1)).cast("int")
        lo, hi = F.get(F.col("_v"), place - 1), F.get(F.col("_v"), place)
        return F.struct(w["j"].alias("j"), (lo + (hi - lo) * (w["_at"] - (w["_upper"] - 1))).alias("v"))

    return rows.select(key, F.inline(F.transform("_want", value)))


def axis_change(samples: DataFrame, key: str, order: Sequence[str], angle: Column) -> DataFrame:
    """(key, samples, delta_deg): negated change of the body angle (degrees) between the first and the last sample, folded as the study folds it. Nothing but the two
    ends of a recording is kept, also before the shuffle."""
    ends = samples.select(key, F.struct(*order).alias("_o"), angle.alias("_a")).groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"), F.min_by("_a", "_o").alias("_first"), F.max_by("_a", "_o").alias("_last"))
    turn = -(F.col("_last") - F.col("_first"))
    return ends.select(key, "samples", F.when(turn > 180, 360 - turn).when(turn < -180, -(360 + turn)).otherwise(turn).alias("delta_deg"))


def measured(segs: DataFrame, change: DataFrame, key: str, fps: float, scale: float) -> DataFrame:
    """(key, duration_s, distance, heading_change) of long recordings, as the quality filter reads them."""
    both = path_distance(segs, key, scale).join(change, key)
    return both.select(key, (F.col("samples") / F.lit(fps)).alias("duration_s"), "distance", F.col("delta_deg").alias("heading_change"))
