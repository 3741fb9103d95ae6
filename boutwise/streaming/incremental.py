"""Streaming counterparts: running moments per key, and the interval to the bout before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.scratch import scratch


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and variance per key so far; the state is three numbers per key and the partial
    aggregates of a micro-batch are merged before the shuffle."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def overall_moments(per_key: DataFrame) -> DataFrame:
    """The moments of all samples from those per key."""
    n = F.col("n").cast("double")
    g = per_key.agg(F.sum("n").alias("n"), F.sum(n * F.col("mean")).alias("_s"), F.sum(n * (F.col("var") + F.col("mean") * F.col("mean"))).alias("_q"))
    m = F.col("_s") / F.col("n")
    return g.select("n", m.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - m * m, F.lit(0.0))).alias("std"))


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over what is available and returns its result table. In complete mode each
    micro-batch replaces the table, in append mode it adds to it."""
    spark = stream.sparkSession
    path, ckpt = scratch(spark, name), scratch(spark, f"{name}-progress")

    def write(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a replayed epoch overwrites itself
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(path)
    return out.drop("epoch") if "epoch" in out.columns else out


GRACE = "10000 days"
STATE = "last double, newest long, at binary, start binary, end binary"  # waiting bouts as packed numbers


def online_intervals(stream: DataFrame, key: str, time: str, delay: str, forget_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame (key, start, end, interval, late) of the bouts (key, `time`, start, end); `interval` is start minus the end of the unit's bout before.

    A bout waits in its unit's state until the watermark (the largest `time` seen in earlier micro-batches minus `delay`) has passed it by more than a
    millisecond, so that nothing earlier can come; then a timer lets it out, in the order of (time, start, end), whatever batches the bouts came in. A bout
    whose time is below the watermark on arrival is late: it comes out at once without an interval and moves nothing (bouts more than `GRACE` behind are dropped and
    counted by Spark). A unit's first bout has no interval. A row without a start is a heartbeat: it moves the watermark and gives no row.

    The state of a unit is one end and the bouts of the last `delay`; with `forget_ms` a unit without a bout for so long leaves the state, and its
    next bout counts as its first."""
    kind = dict(stream.dtypes)[key]
    # Spark drops rows whose event time is below the watermark. A clock that runs GRACE ahead, under a delay longer by as much, has the same watermark
    # and lets late rows through to be marked
    clock = F.col(time) + F.expr(f"interval {GRACE}")
    rows = stream.withColumn("_clock", clock).withWatermark("_clock", f"{GRACE} {delay}").select(
        key, "_clock", F.floor(F.unix_micros(time) / 1000).cast("long").alias("_at"), F.col("start").cast("double").alias("start"),
        F.col("end").cast("double").alias("end"))

    def step(unit: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        last, newest, *waiting = state.get if state.exists else (None, None, b"", b"", b"")
        # arrays, as a unit has few bouts in a batch and frames cost more than their rows
        parts = [[np.frombuffer(bytes(w), kind)] for w, kind in zip(waiting, (np.int64, float, float), strict=True)]
        if not state.hasTimedOut:
            for b in batches:
                at, start, end = (b[c].to_numpy() for c in ("_at", "start", "end"))
                start, end = start.astype(float), end.astype(float)
                known = ~np.isnan(start) & ~np.isnan(at)
                at, start, end = at[known].astype(np.int64), start[known], end[known]
                late = at < mark
                if late.any():
                    yield pd.DataFrame({key: [unit[0]] * int(late.sum()), "start": start[late], "end": end[late], "interval": np.nan, "late": True})
                for part, new in zip(parts, (at, start, end), strict=True):
                    part.append(new[~late])
        at, start, end = (np.concatenate(p) for p in parts)
        order = np.lexsort((end, start, at))
        at, start, end = at[order], start[order], end[order]
        out = int(np.searchsorted(at, mark - 1))
        if out:
            before = np.concatenate(([np.nan if last is None else last], end[:out - 1]))
            yield pd.DataFrame({key: [unit[0]] * out, "start": start[:out], "end": end[:out], "interval": start[:out] - before, "late": False})
            last, newest = float(end[out - 1]), int(at[out - 1])
        held = at[out:]
        if not len(held) and (last is None or forget_ms is not None and newest + forget_ms + 1 <= mark):
            if state.exists:
                state.remove()
            return
        state.update((last, newest, *[v[out:].tobytes() for v in (at, start, end)]))
        if len(held):
            state.setTimeoutTimestamp(int(held[0]) + 1)
        elif forget_ms is not None:
            state.setTimeoutTimestamp(newest + forget_ms + 1)

    schema = f"`{key}` {kind}, start double, end double, interval double, late boolean"
    out = rows.groupBy(key).applyInPandasWithState(step, schema, STATE, "append", "EventTimeTimeout")
    # heartbeats make no unit of their own visible, and pandas has NaN for a missing interval
    return out.withColumn("interval", F.nanvl("interval", F.lit(None).cast("double")))
