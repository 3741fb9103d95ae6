"""Per-bout features from array columns: timing, speed, turning, path, model input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.ordering import previous

# The order of the feature columns of both representations.
CORE_FEATURES = [
    "bout_duration_s", "inter_bout_interval_s", "speed_mean", "speed_std", "speed_median", "speed_max",
    "speed_p95", "speed_rms", "accel_abs_mean", "accel_abs_std", "accel_abs_max", "accel_rms",
    "turn_abs_total_rad", "turn_net_rad", "turn_abs_mean_rad", "turn_abs_std_rad", "turn_abs_max_rad",
    "turn_rms_rad",
]
PATH_FEATURES = ["head_net_displacement", "head_path_length", "head_mean_step", "head_max_step"]
VARIABLE_FEATURES = [
    "bout_duration", "inter_bout_interval", "speed_mean", "speed_std", "speed_median", "speed_max",
    "speed_p95", "speed_rms", "speed_change_abs_mean", "speed_change_std", "speed_change_max",
    "speed_change_rms", "turn_total_abs", "turn_net", "turn_abs_mean", "turn_std", "turn_max", "turn_rms",
]
# Set 2 camera scale and frame rate, and the sample rate of set 1.
SET1_HZ = 700.0
SET2_FPS = 160.0
SET2_MM_PER_PX = 0.071
INPUT_LENGTH = 175

BLOCK = 4096  # bouts of one unit that share a task


def duration(start: str = "start", end: str = "end", hz: float = SET1_HZ) -> Column:
    return (F.col(end) - F.col(start)) / F.lit(hz)


def inter_bout_interval(
    bouts: DataFrame, key: str = "fish_id", hz: float = SET1_HZ, first_is_zero: bool = True,
    accepted: Column | None = None, out: str = "inter_bout_interval_s",
) -> DataFrame:
    """Start minus the end of the bout before it within the unit; negative values are kept. With
    `accepted`, only accepted rows stay and count as predecessors. First row: 0 or NULL."""
    rows = bouts if accepted is None else bouts.where(accepted)
    block = F.floor(F.col("bout_index") / BLOCK)
    linked = previous(rows, [key], "bout_index", ["end"], block, prefix="_prev_")
    gap = (F.col("start") - F.col("_prev_end")) / F.lit(hz)
    return linked.withColumn(out, F.coalesce(gap, F.lit(0.0)) if first_is_zero else gap).drop("_prev_end")


def speed_summaries(speed: str = "speed") -> dict[str, Column]:
    """Mean, std, median, max, p95, rms of |speed|; needs the columns of `stage_speed`."""
    m, s = F.col("_speed_m"), F.col("_speed_sorted")
    return {
        "speed_mean": A.m_mean(m), "speed_std": A.m_std(m), "speed_median": A.sorted_quantile(s, 0.5),
        "speed_max": m["top"], "speed_p95": A.sorted_quantile(s, 0.95), "speed_rms": A.m_rms(m),
    }


def stage_speed(df: DataFrame, speed: str = "speed", absolute: bool = True) -> DataFrame:
    """Adds the shared intermediate arrays once, so that no lambda is evaluated twice."""
    base = A.magnitude(F.col(speed)) if absolute else F.col(speed)
    staged = df.withColumn("_speed_a", base)
    return staged.withColumns({"_speed_m": A.moments(F.col("_speed_a")), "_speed_sorted": F.sort_array("_speed_a")})


def core_features(bouts: DataFrame, key: str = "fish_id", hz: float = SET1_HZ, extended: bool = False) -> DataFrame:
    """The 18 features of fixed-rate bouts (22 with the path features), next to the input's scalar
    columns. Input: speed, heading arrays and start, end frames (x, y arrays when extended).
    One shuffle, for the interval; the rest is a projection."""
    linked = inter_bout_interval(bouts, key, hz)
    staged = stage_speed(linked)
    staged = staged.withColumns({
        "_accel_m": A.moments(F.transform(A.diff(F.col("_speed_a")), lambda d: F.abs(d) * F.lit(hz))),
        "_turn": A.wrapped_turns(F.col("heading")),
    })
    staged = staged.withColumns({"_turn_m": A.moments(A.magnitude(F.col("_turn"))), "_turn_net": A.total(F.col("_turn"))})
    a, t = F.col("_accel_m"), F.col("_turn_m")
    cols = {
        "bout_duration_s": duration(hz=hz), "inter_bout_interval_s": F.col("inter_bout_interval_s"),
        **speed_summaries(),
        "accel_abs_mean": A.m_mean(a), "accel_abs_std": A.m_std(a), "accel_abs_max": a["top"], "accel_rms": A.m_rms(a),
        "turn_abs_total_rad": A.m_sum(t), "turn_net_rad": F.when(t["n"] > 0, F.col("_turn_net")),
        "turn_abs_mean_rad": A.m_mean(t), "turn_abs_std_rad": A.m_std(t), "turn_abs_max_rad": t["top"],
        "turn_rms_rad": A.m_rms(t),
    }
    if extended:
        staged, path = _stage_path(staged)
        cols.update(path)
    arrays = {"speed", "heading", "x", "y"}
    keep = [c for c in bouts.columns if c not in arrays]
    return staged.select(*keep, *[c.alias(n) for n, c in cols.items()])


def _stage_path(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    steps = F.zip_with(A.diff(F.col("x")), A.diff(F.col("y")), lambda u, v: F.sqrt(u * u + v * v))
    staged = df.withColumn("_step_m", A.moments(steps))
    m = F.col("_step_m")
    net = F.sqrt(
        F.pow(F.element_at("x", -1) - F.element_at("x", 1), 2) + F.pow(F.element_at("y", -1) - F.element_at("y", 1), 2)
    )
    return staged, {
        "head_net_displacement": F.when(F.size("x") > 0, net), "head_path_length": A.m_sum(m),
        "head_mean_step": A.m_mean(m), "head_max_step": m["top"],
    }


def path_features(bouts: DataFrame, ids: list[str]) -> DataFrame:
    """Net displacement, path length, mean and largest step from x and y arrays."""
    staged, cols = _stage_path(bouts)
    return staged.select(*ids, *[c.alias(n) for n, c in cols.items()])


def path_distance(x: Column, y: Column, scale: float = 1.0) -> Column:
    """Travelled distance of the raw path; 0 below two samples."""
    steps = F.zip_with(A.diff(x), A.diff(y), lambda u, v: F.sqrt(u * u + v * v))
    return A.total(steps) * F.lit(scale)


def pointwise_speed(x: Column, y: Column, scale: float = SET2_MM_PER_PX, fps: float = SET2_FPS) -> Column:
    """Step speed with the first step repeated; one sample gives [0], none gives []."""
    factor = F.lit(scale * fps)
    steps = F.zip_with(A.diff(x), A.diff(y), lambda u, v: F.sqrt(u * u + v * v) * factor)
    one = F.transform(F.slice(x, 1, 1), lambda _: F.lit(0.0))
    return F.when(F.size(x) < 2, one).otherwise(F.concat(F.slice(steps, 1, 1), steps))


def heading_change_deg(head_x: Column, head_y: Column, tail_x: Column, tail_y: Column, back: int = 6) -> Column:
    """Negated change of the body axis (tail point `back` from the end to the head) between the first
    and the last frame, in degrees, folded as the study folds it. tail_*: array per frame."""
    def axis(frame: int) -> Column:
        dy = F.element_at(head_y, frame) - F.element_at(F.element_at(tail_y, frame), -back)
        dx = F.element_at(head_x, frame) - F.element_at(F.element_at(tail_x, frame), -back)
        return F.degrees(F.atan2(dy, dx))

    turn = -(axis(-1) - axis(1))
    return F.when(turn > 180, 360 - turn).when(turn < -180, -(360 + turn)).otherwise(turn)


def variable_features(
    bouts: DataFrame, key: str = "fish_id", fps: float = SET2_FPS, accepted: Column | None = None
) -> DataFrame:
    """The 18 features of variable-length bouts: speed change without frame rate and with the std of
    the signed difference, turning from the unwrapped heading, NULL interval on the first bout."""
    linked = inter_bout_interval(bouts, key, fps, first_is_zero=False, accepted=accepted, out="inter_bout_interval")
    staged = stage_speed(linked, absolute=False)
    staged = staged.withColumns({"_ds": A.diff(F.col("speed")), "_turn": A.unwrapped_turns(F.col("heading"))})
    staged = staged.withColumns({
        "_ds_m": A.moments(F.col("_ds")), "_ds_am": A.moments(A.magnitude(F.col("_ds"))),
        "_turn_m": A.moments(F.col("_turn")), "_turn_am": A.moments(A.magnitude(F.col("_turn"))),
    })
    d, da, t, ta = F.col("_ds_m"), F.col("_ds_am"), F.col("_turn_m"), F.col("_turn_am")
    cols = {
        "bout_duration": F.size("speed") / F.lit(fps), "inter_bout_interval": F.col("inter_bout_interval"),
        **speed_summaries(),
        "speed_change_abs_mean": A.m_mean(da), "speed_change_std": A.m_std(d), "speed_change_max": da["top"],
        "speed_change_rms": A.m_rms(d), "turn_total_abs": A.m_sum(ta), "turn_net": A.m_sum(t),
        "turn_abs_mean": A.m_mean(ta), "turn_std": A.m_std(t), "turn_max": ta["top"], "turn_rms": A.m_rms(t),
    }
    keep = [c for c in bouts.columns if c not in {"speed", "heading", "x", "y"}]
    return staged.select(*keep, *[c.alias(n) for n, c in cols.items()])


def model_input(df: DataFrame, ids: list[str], speed: str = "speed", heading: str = "heading", length: int | None = None) -> DataFrame:
    """The three model channels sin(angle), cos(angle), speed as array<float>; with `length` the
    unwrapped angle and the speed are first resampled. A non-finite sample fails the job."""
    staged = df.select(*ids, F.col(heading).alias("_angle"), F.col(speed).alias("_pace"))
    if length is not None:
        # unwrapped first as a column of its own: the resampling lambda reads it many times
        staged = staged.withColumn("_angle", A.unwrap(F.col("_angle")))
        staged = staged.withColumns({c: A.resample(F.col(c), length) for c in ("_angle", "_pace")})
    bad = F.exists("_angle", A.nonfinite) | F.exists("_pace", A.nonfinite)
    guarded = staged.withColumn(
        "_angle", F.when(bad, F.raise_error(F.lit("non-finite model input")).cast("array<double>")).otherwise(F.col("_angle"))
    )
    return guarded.select(
        *ids, F.transform("_angle", lambda a: F.sin(a).cast("float")).alias("sin_angle"),
        F.transform("_angle", lambda a: F.cos(a).cast("float")).alias("cos_angle"),
        F.transform("_pace", lambda v: v.cast("float")).alias("speed"),
    )


def mean_speed(speed: str = "speed") -> Column:
    """Signed mean, as the speed controls use it."""
    return A.mean(F.col(speed))
