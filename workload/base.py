"""The study's tables expressed over the test tables, and the same tables as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutwise.functions import hashing as H
from boutwise.operators import clustering as C
from boutwise.operators import longpaths as LP
from boutwise.operators import sampling as S
from boutwise.sources import bouts as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEEDS = [11, 23, 37, 51, 79]
K = 8
SPLIT_SEED = 20260822
ORIGIN_US = 1704067200000000  # 2024-01-01, so that frame numbers stay small
FEATURES_WIDE = ["c_acctbal", "n_orders", "sum_price", "avg_price"]


def query(name: str, oracle: str | None = None):
    """Registers a query under `name`, with its SQL twin where SQL can say it."""
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns (all doubles when none is named) rounded for comparison, counts as bigint."""
    names = cols or [n for n, t in df.dtypes if t in ("double", "float")]
    out = df.withColumns({c: r6(F.col(c).cast("double")) for c in names})
    return out.withColumns({n: F.col(n).cast("bigint") for n, t in out.dtypes if t in ("int", "smallint")})


# ---- sample streams: events in runs of 16 ------------------------------------------------------

def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("fish_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id",
        F.col("value").alias("speed"),
        (F.get_json_object("props", "$.k").cast("double") * F.lit(3.141592653589793) / 50.0).alias("heading"),
        "event_type",
    )


def bouts(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("us") / F.lit(86400000000))
    b = B.cut_bouts(samples(spark, d), "fish_id", ["us", "event_id"], day, 16, ["us", "speed", "heading", "event_type"])
    frame = lambda i: (F.element_at("us", i) - F.lit(ORIGIN_US)).cast("double") * 700.0 / 1e6
    return b.select(
        "fish_id", "bout_index", "speed", "heading", frame(1).alias("start"), frame(-1).alias("end"),
        F.element_at("event_type", 1).alias("stimulus"),
    )


SAMPLES = """
samples AS (SELECT *, (_rn-1)//16 AS bout_index, (_rn-1)%16 AS pos FROM (
  SELECT user_id AS fish_id, epoch_us(ts) AS us, event_id, value AS speed, event_type,
    CAST(json_extract_string(props,'$.k') AS DOUBLE)*3.141592653589793/50.0 AS heading,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS _rn FROM events))"""
BOUTS = SAMPLES + """,
bouts AS (SELECT fish_id, bout_index, count(*) AS n, min((us-1704067200000000)::DOUBLE*700.0/1e6) AS "start",
    max((us-1704067200000000)::DOUBLE*700.0/1e6) AS "end", arg_min(event_type, pos) AS stimulus
  FROM samples GROUP BY ALL),
steps AS (SELECT *, abs(speed) AS a, abs(abs(speed)-lag(abs(speed)) OVER w)*700.0 AS acc,
    speed-lag(speed) OVER w AS ds, heading-lag(heading) OVER w AS dh,
    atan2(sin(heading-lag(heading) OVER w), cos(heading-lag(heading) OVER w)) AS turn
  FROM samples WINDOW w AS (PARTITION BY fish_id, bout_index ORDER BY pos))"""
CORE = BOUTS + """,
summary AS (SELECT fish_id, bout_index, avg(a) speed_mean, stddev_pop(a) speed_std, median(a) speed_median,
    max(a) speed_max, quantile_cont(a,0.95) speed_p95, sqrt(avg(a*a)) speed_rms,
    avg(acc) accel_abs_mean, stddev_pop(acc) accel_abs_std, max(acc) accel_abs_max, sqrt(avg(acc*acc)) accel_rms,
    sum(abs(turn)) turn_abs_total_rad, sum(turn) turn_net_rad, avg(abs(turn)) turn_abs_mean_rad,
    stddev_pop(abs(turn)) turn_abs_std_rad, max(abs(turn)) turn_abs_max_rad, sqrt(avg(turn*turn)) turn_rms_rad
  FROM steps GROUP BY ALL),
core AS (SELECT b.fish_id, b.bout_index, b.stimulus, ("end"-"start")/700.0 AS bout_duration_s,
    coalesce(("start"-lag("end") OVER (PARTITION BY b.fish_id ORDER BY b.bout_index))/700.0, 0.0) AS inter_bout_interval_s,
    s.* EXCLUDE (fish_id, bout_index)
  FROM bouts b JOIN summary s USING (fish_id, bout_index))"""


# ---- units, contexts and the frozen split ------------------------------------------------------

def fish(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("fish_id")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(
        "fish_id", F.ceil(F.col("n") / 16.0).cast("bigint").alias("valid_bouts"), "n",
        F.concat(F.lit("c"), (F.col("fish_id") % 5).cast("string")).alias("context_name"),
    )


def split(spark: SparkSession, d: str) -> DataFrame:
    return S.unit_split(fish(spark, d).select("fish_id", "context_name"), "fish_id", "context_name", SPLIT_SEED)


FISH = """
fish AS (SELECT user_id AS fish_id, CAST(ceil(count(*)/16.0) AS BIGINT) AS valid_bouts, count(*) AS n,
    'c' || (user_id % 5) AS context_name FROM events GROUP BY user_id),
split AS (SELECT fish_id, context_name, CASE WHEN rn <= m-2*v THEN 'train' WHEN rn <= m-v THEN 'validation' ELSE 'test' END AS partition
  FROM (SELECT *, row_number() OVER (PARTITION BY context_name ORDER BY md5('20260822:' || fish_id), fish_id) AS rn,
    count(*) OVER (PARTITION BY context_name) AS m,
    greatest(1, CAST(round_even(0.15*count(*) OVER (PARTITION BY context_name), 0) AS BIGINT)) AS v FROM fish))"""


# ---- embeddings and five labelings -------------------------------------------------------------

def embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    u = H.draw("part", "vec_id") % 100
    return e.select(
        "vec_id", "embedding", F.col("label").cast("bigint").alias("label"),
        F.when(u < 70, "train").when(u < 85, "validation").otherwise("test").alias("partition"),
    )


def seed_centres(spark: SparkSession, d: str, k: int = K) -> dict[int, C.Centres]:
    # drawn from the training part alone, as every frozen model is
    e = embeddings(spark, d).where("partition = 'train'")
    return {s: C.hashed_centres(e, "vec_id", "embedding", k, s) for s in SEEDS}


def labelings(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, partition, seed, cluster), one row per embedding and seed."""
    return C.assign_many(
        embeddings(spark, d), "embedding", seed_centres(spark, d), keep=["vec_id", "label", "partition"]
    )


EMB = """
emb AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::BIGINT AS label,
    CASE WHEN ('0x'||substr(md5('part:'||vec_id),1,8))::BIGINT % 100 < 70 THEN 'train'
         WHEN ('0x'||substr(md5('part:'||vec_id),1,8))::BIGINT % 100 < 85 THEN 'validation' ELSE 'test' END AS partition
  FROM embeddings)"""
LAB = EMB + """,
centres AS (SELECT seed, e AS c, row_number() OVER (PARTITION BY seed ORDER BY md5(seed||':'||vec_id), vec_id)-1 AS cluster
  FROM emb, (SELECT unnest([11,23,37,51,79]) AS seed) WHERE partition='train'
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY md5(seed||':'||vec_id), vec_id) <= 8),
distances AS (SELECT vec_id, label, partition, seed::BIGINT AS seed, cluster, list_distance(e, c) AS dist FROM emb, centres),
lab AS (SELECT vec_id, label, partition, seed, cluster FROM distances
  QUALIFY row_number() OVER (PARTITION BY vec_id, seed ORDER BY dist, cluster) = 1)"""


# ---- variable-length rows: lineitem by order ---------------------------------------------------

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_slot() -> Column:
    """Monotone along LINE_ORDER: splits the lines of a hot order."""
    return F.col("l_linenumber").cast("bigint") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / 256)


def order_paths(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: x, y and heading arrays in a fixed line order."""
    li = table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER)
    b = B.whole_bouts(li, "l_orderkey", LINE_ORDER, ["l_quantity", "l_extendedprice", "l_discount"])
    return b.select(
        "l_orderkey", "bout_index", F.col("l_quantity").alias("x"), F.transform("l_extendedprice", lambda v: v / 1000.0).alias("y"),
        F.transform("l_discount", lambda v: v * 60.0).alias("heading"),
    )


def order_samples(spark: SparkSession, d: str) -> DataFrame:
    """Lines as samples: x, y and heading next to the columns of the line order."""
    li = table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER)
    return li.select(
        "l_orderkey", *LINE_ORDER, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 60.0).alias("heading"),
    )


def order_segments(spark: SparkSession, d: str, fields: list[str], length: int = LP.SEGMENT) -> DataFrame:
    """Orders as recordings of any length, in segments."""
    return LP.segments(order_samples(spark, d), "l_orderkey", LINE_ORDER, line_slot(), fields, length)


def body_angle() -> Column:
    """Body axis of a line in degrees; its tail point is (y/2 - 3, x/2 - 3)."""
    return F.degrees(F.atan2(F.col("y") - (F.col("x") * 0.5 - 3.0), F.col("x") - (F.col("y") * 0.5 - 3.0)))


LINES = """
lines AS (SELECT l_orderkey, 0::BIGINT AS bout_index, rn AS i, x, y, heading, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (
  SELECT l_orderkey, l_quantity AS x, l_extendedprice/1000.0 AS y, l_discount*60.0 AS heading,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem)),
moves AS (SELECT *, x-lag(x) OVER w AS dx, y-lag(y) OVER w AS dy,
    sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)) AS step FROM lines
  WINDOW w AS (PARTITION BY l_orderkey, bout_index ORDER BY i))"""
