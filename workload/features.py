"""Bindings of the array feature operators."""

from pyspark.sql import functions as F

from boutwise.functions import arrays as A
from boutwise.operators import features as FE
from boutwise.operators import longpaths as LP

from .base import BOUTS, CORE, LINE_ORDER, LINES, SAMPLES, body_angle, bouts, order_samples, order_segments, query, r6, rounded

IDS = ["fish_id", "bout_index"]


def _cols(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("feat_01_duration", f"WITH {CORE} SELECT fish_id, bout_index, round(bout_duration_s,6) AS bout_duration_s FROM core")
def _(spark, d):
    return bouts(spark, d).select(*IDS, r6(FE.duration()).alias("bout_duration_s"))


@query("feat_02_interval_first_zero", f"WITH {CORE} SELECT fish_id, bout_index, round(inter_bout_interval_s,6) AS inter_bout_interval_s FROM core")
def _(spark, d):
    out = FE.inter_bout_interval(bouts(spark, d).drop("speed", "heading"))
    return rounded(out.select(*IDS, "inter_bout_interval_s"))


@query("feat_02_interval_accepted", f"""WITH {CORE}, ok AS (SELECT b.* FROM bouts b JOIN summary s USING (fish_id,bout_index) WHERE s.speed_max < 250)
SELECT fish_id, bout_index, round(("start"-lag("end") OVER (PARTITION BY fish_id ORDER BY bout_index))/160.0,6) AS ibi FROM ok""")
def _(spark, d):
    out = FE.inter_bout_interval(
        bouts(spark, d), hz=FE.SET2_FPS, first_is_zero=False, accepted=F.array_max("speed") < 250, out="ibi"
    )
    return rounded(out.select(*IDS, "ibi"))


SPEED = ["speed_mean", "speed_std", "speed_median", "speed_max", "speed_p95", "speed_rms"]


@query("feat_03_speed_summaries", f"WITH {CORE} SELECT fish_id, bout_index, {_cols(SPEED)} FROM core")
def _(spark, d):
    staged = FE.stage_speed(bouts(spark, d).select(*IDS, "speed"))
    return rounded(staged.select(*IDS, *[c.alias(n) for n, c in FE.speed_summaries().items()]))


ACC = ["accel_abs_mean", "accel_abs_std", "accel_abs_max", "accel_rms"]


@query("feat_04_acceleration", f"WITH {CORE} SELECT fish_id, bout_index, {_cols(ACC)} FROM core")
def _(spark, d):
    return rounded(FE.core_features(bouts(spark, d)).select(*IDS, *ACC))


SETB = """WITH {base}, unw AS (SELECT *, CASE WHEN abs(dh) < pi() THEN dh ELSE dh - 2*pi()*floor((dh+pi())/(2*pi())) END AS u FROM steps),
unw2 AS (SELECT * REPLACE (CASE WHEN abs(dh) >= pi() AND u = -pi() AND dh > 0 THEN pi() ELSE u END AS u) FROM unw)
SELECT fish_id, bout_index, {cols} FROM unw2 GROUP BY ALL"""
CHANGE = {
    "speed_change_abs_mean": "avg(abs(ds))", "speed_change_std": "stddev_pop(ds)",
    "speed_change_max": "max(abs(ds))", "speed_change_rms": "sqrt(avg(ds*ds))",
}
TURN_B = {
    "turn_total_abs": "sum(abs(u))", "turn_net": "sum(u)", "turn_abs_mean": "avg(abs(u))",
    "turn_std": "stddev_pop(u)", "turn_max": "max(abs(u))", "turn_rms": "sqrt(avg(u*u))",
}


def _setb(cols):
    return SETB.format(base=BOUTS, cols=", ".join(f"round({e},6) AS {n}" for n, e in cols.items()))


@query("feat_05_speed_change", _setb(CHANGE))
def _(spark, d):
    return rounded(FE.variable_features(bouts(spark, d)).select(*IDS, *CHANGE))


TURN = ["turn_abs_total_rad", "turn_net_rad", "turn_abs_mean_rad", "turn_abs_std_rad", "turn_abs_max_rad", "turn_rms_rad"]


# A step of exactly half a turn has no defined side in floating point; such bouts keep only the
# side-free columns in both forms below.
@query("feat_06_wrapped_turning", f"""WITH {CORE}, half AS (SELECT DISTINCT fish_id, bout_index FROM steps WHERE abs(abs(turn)-pi())<1e-9)
SELECT c.fish_id, c.bout_index, {', '.join(f'round({c},6) AS {c}' for c in TURN if c != 'turn_net_rad')},
  CASE WHEN h.fish_id IS NULL THEN round(turn_net_rad,6)+0.0::DOUBLE END AS turn_net_rad
FROM core c LEFT JOIN half h USING (fish_id, bout_index)""")
def _(spark, d):
    b = bouts(spark, d)
    half = F.exists(A.wrapped_turns(F.col("heading")), lambda t: F.abs(F.abs(t) - A.PI) < 1e-9)
    out = FE.core_features(b.withColumn("half", half))
    return rounded(out.withColumn("turn_net_rad", F.when(~F.col("half"), F.col("turn_net_rad"))).select(*IDS, *TURN))


@query("feat_07_unwrapped_turning", _setb({k: v for k, v in TURN_B.items() if k in ("turn_total_abs", "turn_abs_mean", "turn_max", "turn_rms")}))
def _(spark, d):
    return rounded(FE.variable_features(bouts(spark, d)).select(*IDS, "turn_total_abs", "turn_abs_mean", "turn_max", "turn_rms"))


# an order is one recording of any length
ORDER_IDS = ["l_orderkey", "0L AS bout_index"]


# discounts are hundredths up to .1, so no step here is half a turn and every column can be compared
@query("feat_07_long_turning", f"""WITH {LINES}, d AS (SELECT l_orderkey, heading-lag(heading) OVER (PARTITION BY l_orderkey ORDER BY i) AS h FROM lines), u AS (SELECT l_orderkey, atan2(sin(h), cos(h)) AS u FROM d)
SELECT l_orderkey, {', '.join(f'round({e},6)+0.0::DOUBLE AS {n}' for n, e in TURN_B.items())} FROM u GROUP BY l_orderkey""")
def _(spark, d):
    return rounded(LP.turning_features(order_segments(spark, d, ["heading"]), "l_orderkey"))


@query("feat_08_path_features", f"""WITH {LINES} SELECT l_orderkey, bout_index,
round(sqrt(pow(arg_max(x,i)-arg_min(x,i),2)+pow(arg_max(y,i)-arg_min(y,i),2)),6) AS head_net_displacement,
round(sum(step),6) AS head_path_length, round(avg(step),6) AS head_mean_step, round(max(step),6) AS head_max_step
FROM moves GROUP BY l_orderkey, bout_index""")
def _(spark, d):
    found = LP.path_features(order_segments(spark, d, ["x", "y"]), "l_orderkey")
    return rounded(found.selectExpr(*ORDER_IDS, *FE.PATH_FEATURES))


@query("feat_09_pointwise_speed", f"""WITH {LINES}, s AS (SELECT l_orderkey, bout_index, i-1 AS pos,
  CASE WHEN n=1 THEN 0.0::DOUBLE WHEN i=1 THEN lead(step) OVER (PARTITION BY l_orderkey, bout_index ORDER BY i) ELSE step END * (0.071*160.0)::DOUBLE AS v FROM moves)
SELECT l_orderkey, bout_index, pos, round(v,6) AS v FROM s""")
def _(spark, d):
    found = LP.pointwise_speed(order_segments(spark, d, ["x", "y"]), "l_orderkey", FE.SET2_MM_PER_PX * FE.SET2_FPS)
    return rounded(found.selectExpr(*ORDER_IDS, "pos", "v"))


@query("feat_10_path_distance", f"""WITH {LINES} SELECT l_orderkey, bout_index, round(coalesce(sum(step),0)*0.071::DOUBLE,6) AS distance_mm FROM moves GROUP BY l_orderkey, bout_index""")
def _(spark, d):
    found = LP.path_distance(order_segments(spark, d, ["x", "y"]), "l_orderkey", FE.SET2_MM_PER_PX)
    return rounded(found.selectExpr(*ORDER_IDS, "distance AS distance_mm"))


@query("feat_11_heading_change", f"""WITH {LINES}, t AS (SELECT l_orderkey, bout_index,
  arg_min(degrees(atan2(y-(x*0.5-3.0), x-(y*0.5-3.0))),i) s0, arg_max(degrees(atan2(y-(x*0.5-3.0), x-(y*0.5-3.0))),i) s1 FROM lines GROUP BY l_orderkey, bout_index),
 u AS (SELECT l_orderkey, bout_index, -(s1-s0) AS a FROM t)
SELECT l_orderkey, bout_index, round(CASE WHEN a>180 THEN 360-a WHEN a<-180 THEN -(360+a) ELSE a END,6)+0.0::DOUBLE AS delta_deg FROM u""")
def _(spark, d):
    found = LP.axis_change(order_samples(spark, d), "l_orderkey", LINE_ORDER, body_angle())
    return rounded(found.selectExpr(*ORDER_IDS, "delta_deg"))


@query("feat_12_resample", f"""WITH {LINES}, g AS (SELECT unnest(range(25)) AS j),
o AS (SELECT l_orderkey, bout_index, any_value(n) AS n FROM lines GROUP BY l_orderkey, bout_index HAVING any_value(n)>=2),
q AS (SELECT l_orderkey, bout_index, j, j*(n-1)/24.0::DOUBLE AS pos, least(floor(j*(n-1)/24.0::DOUBLE), n-2)::BIGINT AS lo FROM o, g)
SELECT q.l_orderkey, q.bout_index, q.j, round(a.x+(b.x-a.x)*(q.pos-q.lo),6) AS v FROM q
JOIN lines a ON a.l_orderkey=q.l_orderkey AND a.bout_index=q.bout_index AND a.i=q.lo+1 JOIN lines b ON b.l_orderkey=q.l_orderkey AND b.bout_index=q.bout_index AND b.i=q.lo+2""")
def _(spark, d):
    found = LP.resample(order_segments(spark, d, ["x"]), "l_orderkey", "x", 25)
    return rounded(found.selectExpr(*ORDER_IDS, "j", "v"))


@query("feat_13_model_input", f"""WITH {SAMPLES} SELECT fish_id, bout_index, pos, round(sin(heading)::FLOAT::DOUBLE,5)+0.0::DOUBLE AS s,
round(cos(heading)::FLOAT::DOUBLE,5)+0.0::DOUBLE AS c, round(speed::FLOAT::DOUBLE,5) AS v FROM samples""")
def _(spark, d):
    m = FE.model_input(bouts(spark, d), IDS)
    z = m.select(*IDS, F.posexplode(F.arrays_zip("sin_angle", "cos_angle", "speed")).alias("pos", "z"))
    r = lambda c: F.round(F.col(c).cast("double"), 5) + F.lit(0.0)
    return z.select(
        *IDS, F.col("pos").cast("bigint").alias("pos"), r("z.sin_angle").alias("s"), r("z.cos_angle").alias("c"),
        r("z.speed").alias("v"),
    )


@query("feat_14_core_vector", f"""WITH {CORE} SELECT fish_id, bout_index, stimulus, {_cols([c for c in FE.CORE_FEATURES if c != 'turn_net_rad'])} FROM core""")
def _(spark, d):
    out = FE.core_features(bouts(spark, d)).drop("start", "end", "turn_net_rad")
    return rounded(out)


VARIABLE = [c for c in FE.VARIABLE_FEATURES if c not in ("turn_net", "turn_std")]


@query("feat_14_variable_vector", f"""WITH {BOUTS}, g AS (SELECT fish_id, bout_index, n/160.0::DOUBLE AS bout_duration, ("start"-lag("end") OVER (PARTITION BY fish_id ORDER BY bout_index))/160.0::DOUBLE AS inter_bout_interval FROM bouts),
u AS (SELECT *, abs(atan2(sin(dh), cos(dh))) AS t FROM steps),
s AS (SELECT fish_id, bout_index, avg(speed) AS speed_mean, stddev_pop(speed) AS speed_std, median(speed) AS speed_median, max(speed) AS speed_max, quantile_cont(speed,0.95) AS speed_p95, sqrt(avg(speed*speed)) AS speed_rms,
 avg(abs(ds)) AS speed_change_abs_mean, stddev_pop(ds) AS speed_change_std, max(abs(ds)) AS speed_change_max, sqrt(avg(ds*ds)) AS speed_change_rms,
 sum(t) AS turn_total_abs, avg(t) AS turn_abs_mean, max(t) AS turn_max, sqrt(avg(t*t)) AS turn_rms FROM u GROUP BY ALL)
SELECT fish_id, bout_index, {_cols(VARIABLE)} FROM g JOIN s USING (fish_id, bout_index)""")
def _(spark, d):
    return rounded(FE.variable_features(bouts(spark, d)).select(*IDS, *VARIABLE))


@query("feat_15_mean_speed", f"WITH {SAMPLES} SELECT fish_id, bout_index, round(avg(speed),6) AS mean_speed FROM samples GROUP BY ALL")
def _(spark, d):
    return bouts(spark, d).select(*IDS, r6(FE.mean_speed()).alias("mean_speed"))
