"""Segmented recordings give what the array form gives, whatever the segment length; a long one is spread over tasks."""

import math

import pytest
from pyspark.sql import functions as F

from boutwise.functions import arrays as A
from boutwise.operators import features as FE
from boutwise.operators import longpaths as LP
from workload import base as W

DIR = "/root/testdata/sf0.001"


def by_key(df, digits=9):
    return {tuple(r)[0]: tuple(None if v is None else round(v, digits) for v in tuple(r)[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def whole(spark):
    return W.order_paths(spark, DIR).cache()


@pytest.mark.parametrize("length", [2, 3, LP.SEGMENT])
def test_every_order_in_segments(spark, whole, length):
    segs = W.order_segments(spark, DIR, ["x", "y", "heading"], length).cache()
    assert segs.agg(F.max(F.size("x"))).first()[0] <= length
    plain = FE.path_features(whole, ["l_orderkey"])
    assert by_key(LP.path_features(segs, "l_orderkey").drop("samples")) == by_key(plain)

    t = whole.select("l_orderkey", A.unwrapped_turns(F.col("heading")).alias("t"))
    m, a = A.moments(F.col("t")), A.moments(A.magnitude(F.col("t")))
    plain = t.select("l_orderkey", A.m_sum(a), A.m_sum(m), A.m_mean(a), A.m_std(m), a["top"], A.m_rms(m))
    assert by_key(LP.turning_features(segs, "l_orderkey")) == by_key(plain)

    plain = whole.select("l_orderkey", F.posexplode(FE.pointwise_speed(F.col("x"), F.col("y"), 1.0, 2.0)).alias("pos", "v"))
    assert sorted(map(tuple, LP.pointwise_speed(segs, "l_orderkey", 2.0).collect())) == sorted(map(tuple, plain.collect()))

    plain = whole.select("l_orderkey", F.posexplode(A.resample(F.col("x"), 9)).alias("j", "v"))
    exact = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    long_form = exact(LP.resample(segs, "l_orderkey", "x", 9))
    # the array form returns an array of the wanted length as it is
    assert long_form == exact(plain)


def test_one_long_recording_is_spread(spark):
    n, length = 120_000, 1000
    s = spark.range(n).select(F.lit(7).alias("key"), F.col("id").alias("us"), F.sin(F.col("id") * 0.37).alias("x"), F.cos(F.col("id") * 0.11).alias("y"), (F.col("id") % 5 * 0.9).alias("heading"))
    short = spark.createDataFrame([(8, 0, 1.0, 2.0, 0.0)], "key int, us long, x double, y double, heading double")
    segs = LP.segments(s.unionByName(short).repartition(5), "key", ["us"], F.floor(F.col("us") / 500), ["x", "y", "heading"], length).cache()
    sizes = segs.where("key = 7").agg(F.count("*"), F.max(F.size("x")), F.count("_before")).first()
    assert tuple(sizes) == (n // length, length, n // length - 1)

    x, y = [math.sin(i * 0.37) for i in range(n)], [math.cos(i * 0.11) for i in range(n)]
    steps = [math.hypot(x[i + 1] - x[i], y[i + 1] - y[i]) for i in range(n - 1)]
    got = by_key(LP.path_features(segs, "key"), 6)
    assert got[7] == (n, round(math.hypot(x[-1] - x[0], y[-1] - y[0]), 6), round(math.fsum(steps), 6), round(math.fsum(steps) / (n - 1), 6), round(max(steps), 6))
    assert got[8] == (1, 0.0, None, None, None)

    fold = lambda d: math.atan2(math.sin(d), math.cos(d))
    t = [fold((((i + 1) % 5) - i % 5) * 0.9) for i in range(n - 1)]
    mean = math.fsum(t) / len(t)
    want = (math.fsum(map(abs, t)), math.fsum(t), math.fsum(map(abs, t)) / len(t), math.sqrt(math.fsum((v - mean) ** 2 for v in t) / len(t)), max(map(abs, t)), math.sqrt(math.fsum(v * v for v in t) / len(t)))
    assert by_key(LP.turning_features(segs, "key"), 6)[7] == tuple(round(v, 6) for v in want)
    assert by_key(LP.turning_features(segs, "key"), 6)[8] == (None,) * 6

    got = {r["j"]: r["v"] for r in LP.resample(segs, "key", "x", 101).where("key = 7").collect()}
    for j in range(101):
        at = j * (n - 1) / 100
        lo = min(int(at), n - 2)
        assert abs(got[j] - (x[lo] + (x[lo + 1] - x[lo]) * (at - lo))) < 1e-9
    assert LP.resample(segs, "key", "x", 101).where("key = 8").count() == 0
    speeds = LP.pointwise_speed(segs, "key", 1.0).where("key = 7")
    assert speeds.agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first()[:] == (n, n, n - 1)
    assert [r["v"] for r in LP.pointwise_speed(segs, "key", 1.0).where("key = 8").collect()] == [0.0]


def test_ties_repeats_and_no_rows(spark):
    rows = [(1, 0, 0.0, 0.0)] * 3 + [(1, 1, 3.0, 4.0)] * 2
    df = spark.createDataFrame(rows, "key int, us long, x double, y double")
    for length in (2, 4):
        segs = LP.segments(df, "key", ["us"], F.col("us"), ["x", "y"], length)
        assert by_key(LP.path_features(segs, "key")) == {1: (5, 5.0, 5.0, 1.25, 5.0)}
        assert LP.path_features(segs.where("false"), "key").collect() == []
    with pytest.raises(ValueError):
        LP.segments(df, "key", ["us"], F.col("us"), ["x", "y"], 1)


def test_body_axis_change_keeps_the_ends(spark):
    df = spark.createDataFrame([(1, 2, 170.0), (1, 0, -170.0), (1, 1, 0.0), (2, 0, 5.0)], "key int, us long, angle double")
    assert by_key(LP.axis_change(df, "key", ["us"], F.col("angle"))) == {1: (3, -20.0), 2: (1, 0.0)}


def test_resampled_places_are_not_joined_to_segments(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 3 AS k", "id AS t", "id * 1.0D AS x")
    LP.segments(rows, "k", ["t"], F.col("t"), ["x"], 8).write.parquet(str(tmp_path / "s"))
    found = LP.resample(spark.read.parquet(str(tmp_path / "s")), "k", "x", 25)
    got = {(r["k"], r["j"]): r["v"] for r in found.collect()}
    assert len(got) == 75 and all(abs(v - (k + 57 * j / 24)) < 1e-9 for (k, j), v in got.items())
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
