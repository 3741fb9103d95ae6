"""Ranking and quantile helpers on skewed keys, repeats and missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.functions import ordering as O
from boutwise.functions import positions as PO


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(60000) < 0.6, 0, rng.integers(1, 40, 60000))
    value = np.where(rng.random(60000) < 0.35, 5.0, np.round(rng.lognormal(0, 1, 60000), 3))
    pdf_rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(pdf_rows, "k int, t int, v double").repartition(8).cache(), key, value


@pytest.mark.parametrize("limit", [500, 10**6])
def test_row_numbers_split_or_whole(skewed, limit):
    df, key, _ = skewed
    got = O.row_numbers(df, ["k"], ["t"], F.floor(F.col("t") / 1000), "rn", max_rows=limit).select("k", "t", "rn").toPandas()
    want = got.sort_values("t").groupby("k").cumcount() + 1
    assert (got.loc[want.index, "rn"] == want).all() and len(got) == len(key)


@pytest.mark.parametrize("accuracy", [200, 10**5])
def test_quantiles_are_exact(skewed, accuracy):
    df, key, value = skewed
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.505, "f": 0.95, "g": 1.0}
    got = {r["k"]: r for r in O.quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for k in np.unique(key):
        want = np.quantile(value[key == k], list(probs.values()))
        assert np.allclose([got[int(k)][n] for n in probs], want, atol=1e-12)


def test_quantiles_without_keys_and_with_nan(spark):
    rows = [(None,), (float("nan"),), (1.0,), (2.0,), (3.0,), (10.0,)]
    r = O.quantiles(spark.createDataFrame(rows, "v double"), [], "v", {"p95": 0.95, "m": 0.5}).first()
    assert abs(r["p95"] - 8.95) < 1e-12 and r["m"] == 2.5


def test_value_steps_count_smaller_values(skewed):
    df, key, value = skewed
    got = PO.value_steps(df, ["k"], "v").where("k = 0").collect()
    v = np.sort(value[key == 0])
    for r in got[:: max(1, len(got) // 50)]:
        assert r["below"] == np.searchsorted(v, r["v"], "left") and r["c_all"] == (v == r["v"]).sum() and r["n_key"] == len(v)


def test_previous_crosses_buckets(spark):
    rows = [(1, i, float(i * i)) for i in (0, 3, 4, 9, 10, 11, 50)] + [(2, 7, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {(r["k"], r["i"]): r["prev_v"] for r in O.previous(df, ["k"], "i", ["v"], F.floor(F.col("i") / 5)).collect()}
    assert got == {(1, 0): None, (1, 3): 0.0, (1, 4): 9.0, (1, 9): 16.0, (1, 10): 81.0, (1, 11): 100.0, (1, 50): 121.0, (2, 7): None}


def test_runs_cross_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(25)] + [("b", 0, 1), ("b", 1, 2)], "k string, position int, v int")
    got = {(r["k"], r["position"]): list(r["gram"]) for r in O.runs(df, ["k"], "position", "v", 3, block=4).collect()}
    assert got == {("a", i): [i % 3, (i + 1) % 3, (i + 2) % 3] for i in range(23)}


def test_first_rows_take_smallest(spark):
    df = spark.range(5000)
    got = sorted(r["id"] for r in O.first_rows(df, F.md5(F.col("id").cast("string")), 37, ["id"]).collect())
    import hashlib

    assert got == sorted(sorted(range(5000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:37])


@pytest.fixture
def many_ranges(spark):
    """Every shuffle keeps its partitions, so that small tables have many ranges too."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_positions_over_many_ranges(spark, many_ranges):
    """Values of one prefix: the ranges are about equal and the places gapless."""
    d = spark.range(5000, numPartitions=7).select(F.concat(F.lit("one-prefix-"), F.format_string("%06d", (F.col("id") * 7919) % 5000)).alias("s"), "id")
    got = PO.positions(d, ["s"]).collect()
    assert [r["s"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["s"] for r in got)
    assert sorted(r["position"] for r in got) == list(range(5000))
    ranges = PO._ranges(d, ["s"]).groupBy("_range").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 1250
    assert PO.positions(d.where("id < 0"), ["s"]).count() == 0


def test_value_steps_by_key_and_part(spark, many_ranges):
    import math
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(3), rng.choice([None, math.nan, *map(float, range(40))])) for _ in range(3000)]
    d = spark.createDataFrame(rows, "k string, p int, v double")
    fine = [r for r in rows if r[0] is not None and r[2] is not None and not math.isnan(r[2])]
    want = set()
    for k, p, v in set(fine):
        mine = [r for r in fine if r[0] == k]
        want.add((k, p, v, sum(r == (k, p, v) for r in fine), sum(r[2] == v for r in mine), sum(r[2] < v for r in mine), len(mine)))
    got = PO.value_steps(d, ["k"], "v", ["p"]).select("k", "p", "v", "_c", "c_all", "below", "n_key").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
