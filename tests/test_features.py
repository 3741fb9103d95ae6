"""Array features, quality rules, sources and sinks on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.functions import arrays as A
from boutwise.operators import blinding as BL
from boutwise.operators import features as FE
from boutwise.operators import quality as Q
from boutwise.operators import sampling as S
from boutwise.operators import scaling as N
from boutwise.sources import bouts as B
from boutwise.sources import sinks as K


def bouts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(3):
        end = 0.0
        for b in range(4):
            start = end + float(rng.integers(50, 2000))
            end = start + float(rng.integers(60, 200))
            rows.append((f, b, rng.normal(0, 20, 175).tolist(), np.cumsum(rng.normal(0, 1.5, 175)).tolist(), start, end))
    return spark.createDataFrame(rows, "fish_id int, bout_index int, speed array<double>, heading array<double>, start double, end double"), rows


def test_core_features_against_numpy(spark):
    df, rows = bouts(spark)
    got = {(r["fish_id"], r["bout_index"]): r for r in FE.core_features(df).collect()}
    for f, b, s, h, start, end in rows:
        r, a = got[(f, b)], np.abs(s)
        acc = np.abs(np.diff(a)) * 700
        t = np.arctan2(np.sin(np.diff(h)), np.cos(np.diff(h)))
        want = [a.mean(), a.std(), np.median(a), a.max(), np.percentile(a, 95), np.sqrt((a**2).mean()), acc.mean(), acc.std(), acc.max(), np.sqrt((acc**2).mean()),
                np.abs(t).sum(), t.sum(), np.abs(t).mean(), np.abs(t).std(), np.abs(t).max(), np.sqrt((t**2).mean())]
        assert np.allclose([r[c] for c in FE.CORE_FEATURES[2:]], want)
        assert r["speed_max"] >= r["speed_p95"] and r["speed_max"] >= r["speed_median"] and r["speed_rms"] + 1e-6 >= r["speed_mean"]
        assert r["turn_abs_max_rad"] <= math.pi + 1e-5


def test_variable_features_against_numpy(spark):
    df, rows = bouts(spark)
    got = {(r["fish_id"], r["bout_index"]): r for r in FE.variable_features(df).collect()}
    for f, b, s, h, *_ in rows:
        r, ds, t = got[(f, b)], np.diff(s), np.diff(np.unwrap(h))
        want = [np.abs(ds).mean(), ds.std(), np.abs(ds).max(), np.sqrt((ds**2).mean()), np.abs(t).sum(), t.sum(), np.abs(t).mean(), t.std(), np.abs(t).max(), np.sqrt((t**2).mean())]
        assert np.allclose([r[c] for c in FE.VARIABLE_FEATURES[8:]], want)
        assert (r["inter_bout_interval"] is None) == (b == 0)


def test_timing_literals(spark):
    df = spark.createDataFrame([(1, 0, 334.0, 444.0), (1, 1, 2030.0, 2100.0)], "fish_id int, bout_index int, start double, end double")
    got = {r["bout_index"]: r for r in FE.inter_bout_interval(df).withColumn("dur", FE.duration()).collect()}
    assert abs(got[0]["dur"] - 110 / 700) < 1e-12 and got[0]["inter_bout_interval_s"] == 0.0
    assert abs(got[1]["inter_bout_interval_s"] - 1586 / 700) < 1e-12


def test_unwrap_and_resample(spark):
    h = [0.0, 3.0, -3.0, math.pi, 0.0, 6.4, 0.1]
    df = spark.createDataFrame([(h, [1.0, 2.0, 4.0])], "h array<double>, x array<double>")
    r = df.select(A.unwrap(F.col("h")).alias("u"), A.resample(F.col("x"), 5).alias("r"), A.resample(F.slice("x", 1, 1), 5).alias("n")).first()
    assert np.allclose(r["u"], np.unwrap(h)) and r["r"] == [1.0, 1.5, 2.0, 3.0, 4.0] and r["n"] is None


def test_half_turn_keeps_its_side(spark):
    df = spark.createDataFrame([([0.0, math.pi, 0.0],)], "h array<double>")
    assert df.select(A.unwrapped_turns(F.col("h")).alias("u")).first()["u"] == pytest.approx([math.pi, -math.pi])


def test_pointwise_speed_edges(spark):
    df = spark.createDataFrame([([], []), ([1.0], [1.0]), ([0.0, 3.0, 3.0], [0.0, 4.0, 4.0])], "x array<double>, y array<double>")
    got = [r["v"] for r in df.select(FE.pointwise_speed(F.col("x"), F.col("y"), 1.0, 1.0).alias("v")).collect()]
    assert got == [[], [0.0], [5.0, 5.0, 0.0]]


def test_short_bouts_give_null(spark):
    df = spark.createDataFrame([(1, 0, [2.0], [0.5], 0.0, 7.0)], "fish_id int, bout_index int, speed array<double>, heading array<double>, start double, end double")
    r = FE.core_features(df).first()
    assert r["speed_mean"] == 2.0 and r["speed_std"] == 0.0 and r["accel_rms"] is None and r["turn_net_rad"] is None


def test_qc_flags_with_missing(spark):
    rows = [([0.0, 0.0], [1.0, 1.0]), ([1.0, float("nan")], [1.0, 1.0]), ([-150.0, 2.0], [1.0, None]), ([3.0, 4.0], [1.0, float("inf")])]
    got = Q.qc_flags(spark.createDataFrame(rows, "speed array<double>, heading array<double>")).collect()
    assert [r["contains_nonfinite"] for r in got] == [False, True, True, True]
    assert [r["all_zero_speed"] for r in got] == [True, False, False, False]
    assert [r["extreme_speed"] for r in got] == [False, False, True, False] and got[2]["max_abs_speed"] == 150.0


def test_accept_is_strict(spark):
    df = spark.createDataFrame([(0.04, 0.04, 180.0), (1.3, 70.0, 181.0), (0.01, 5.0, 0.0), (0.5, 0.1, 0.0)], "t double, s double, h double")
    got = [(r["accepted"], r["reasons"]) for r in Q.accept(df, "t", "s", "h").collect()]
    assert got[0] == (True, []) and got[1][1] == ["time_too_long", "distance_too_large", "speed_too_high", "heading_change_too_large"]
    assert got[2][1] == ["time_too_short", "speed_too_high"] and got[3][1] == ["speed_too_low"]


def test_known_label_edges(spark):
    raw = ["", " LLC ", "4", "4.0", "13", "14", "-1", "4.5", "nan", "xyz", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(Q.known_label("r")).collect()]
    assert got == ["__MISSING__", "LLC", "J_turn", "J_turn", "HAT", "14", "-1", "4.5", "nan", "xyz", "__MISSING__"]


def test_scaler_refuses_other_partitions(spark):
    df = spark.createDataFrame([("train", 1.0), ("test", 2.0)], "partition string, v double")
    with pytest.raises(Exception, match="non-training"):
        N.fit_scaler(N.require_train(df), ["v"]).collect()


def test_scaler_centres_and_keeps_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    z = N.apply_scaler(df, ["a", "b"], N.fit_scaler(df, ["a", "b"])).collect()
    assert [r["a"] for r in z] == [-1.0, 1.0, None] and [r["b"] for r in z] == [0.0] * 3
    with pytest.raises(Exception, match="no spread"):
        N.fit_scaler(df, ["b"], zero_is_error=True).collect()


def test_split_sizes_and_errors(spark):
    df = spark.createDataFrame([(f"{fam}{i}", fam) for fam, n in (("a", 3), ("b", 10), ("c", 30)) for i in range(n)], "u string, f string")
    got = {(r["f"], r["partition"]): r["count"] for r in S.unit_split(df, "u", "f", 1).groupBy("f", "partition").count().collect()}
    assert got == {("a", "train"): 1, ("a", "validation"): 1, ("a", "test"): 1, ("b", "train"): 6, ("b", "validation"): 2, ("b", "test"): 2,
                   ("c", "train"): 22, ("c", "validation"): 4, ("c", "test"): 4}
    with pytest.raises(Exception, match="three units"):
        S.unit_split(df.where("u in ('a0', 'a1')"), "u", "f", 1).collect()


def test_fish_records_problems(spark):
    m = spark.createDataFrame([("f1", "c1"), ("f2", "c1"), ("f2", "c1"), ("f3", "c2"), ("f5", "c1")], "fish_id string, context_name string")
    s = spark.createDataFrame([("f1", "c1", "train"), ("f2", "c1", "train"), ("f4", "c1", "test"), ("f3", "cX", "test")], "fish_id string, context_name string, partition string")
    got = {r["fish_id"]: r["problem"] for r in B.fish_records(m, s).collect()}
    assert got == {"f1": None, "f2": "duplicate", "f3": "disagree", "f4": "missing_master", "f5": "missing_split"}
    with pytest.raises(Exception, match="bad record"):
        B.require_clean(B.fish_records(m, s)).collect()


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "fish.csv"
    p.write_text("dataset_id,cohort,fish_id,fish_index,valid_bouts,context_id,context_name\nD1,a,f1,0,12.0,c1,one\n")
    assert B.read_fish_master(spark, str(p)).first()["valid_bouts"] == 12
    bad = tmp_path / "bad.csv"
    bad.write_text("dataset_id,other\nD1,a\n")
    with pytest.raises(Exception):
        B.read_fish_master(spark, str(bad)).collect()


def test_bout_keys_cut_long_units(spark):
    f = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "fish_id string, valid_bouts int")
    got = sorted((r["fish_id"], r["bout_index"]) for r in B.bout_keys(f, block=4).collect())
    assert got == [("a", i) for i in range(10)] + [("c", 0)]


def test_dataset_rules_find_faults(spark):
    fish = spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "fish_id int, valid_bouts int, context_name string")
    b = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (2, 2)], "fish_id int, bout_index int")
    got = {r["rule"]: r["passed"] for r in Q.dataset_rules(fish, b, {"units": 2, "contexts": 2, "bouts": 5}).collect()}
    assert not got.pop("bout_index_contiguous") and all(got.values())


def test_embedding_rules_find_faults(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [float("nan"), 0.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    got = {r["rule"]: r["observed"] for r in Q.embedding_rules(df, "id", "v", 2, "id").collect()}
    assert got["finite"] == 1 and got["ids_unique"] == 3 and got["no_zero_norm"] == 1 and got["index_contiguous"] == 5


def test_embedding_writer_refuses_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([("train", [1.0, 2.0]), ("train", [1.0])], "partition string, embedding array<double>")
    with pytest.raises(Exception, match="bad embedding"):
        K.write_embeddings(df, str(tmp_path / "e"), 2)


def test_manifest_statuses(spark, tmp_path):
    for n, t in (("a.txt", "one"), ("b.txt", "two")):
        (tmp_path / n).write_text(t)
    now = K.file_manifest(spark, str(tmp_path), "*.txt")
    import hashlib

    old = spark.createDataFrame([("a.txt", hashlib.sha256(b"one").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "name string, sha256 string")
    assert {r["name"]: r["status"] for r in K.verify_manifest(now, old).collect()} == {"a.txt": "ok", "b.txt": "changed", "c.txt": "missing"}


def test_manifest_reads_files_in_pieces(spark, tmp_path):
    import hashlib

    # names that need escaping, an empty file, one of several pieces, one in a folder below
    big = bytes(range(256)) * (12 << 10)
    texts = {"a b.txt": b"x", "50%25 #1.txt": b"y", "empty.txt": b"", "big.txt": big}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.txt").write_bytes(b"z")
    want = {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in {**texts, "c.txt": b"z"}.items() if t}
    for whole in (0, 1, 1 << 28):  # all in pieces, some, none
        assert {r["name"]: (r["bytes"], r["sha256"]) for r in K.file_manifest(spark, str(tmp_path), whole=whole).collect()} == want


def test_manifest_of_tables_in_folders(spark, tmp_path):
    for n in ("a.parquet/part-0", "a.parquet/part-1", "b.parquet/part-0", "c.parquet"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/../{tmp_path.name}"):
        now = K.file_manifest(spark, root, below=True)
        assert sorted(r["name"] for r in now.collect()) == ["a.parquet/part-0", "a.parquet/part-1", "b.parquet/part-0", "c.parquet"]
    old = now.selectExpr("name", "if(name = 'a.parquet/part-1', '0', sha256) AS sha256").where("name <> 'c.parquet'")
    got = K.folder_statuses(K.verify_manifest(now, old))
    assert {r["name"]: r["status"] for r in got.collect()} == {"a.parquet": "changed", "b.parquet": "ok", "c.parquet": "unrecorded"}


def test_long_numbers_in_ids(spark, tmp_path):
    import duckdb
    import __spark_entry__ as E

    spark.sql("SELECT 7L AS l_orderkey, n AS l_linenumber, p AS l_partkey FROM VALUES (1, 5L), (12, 123456L), (123, 1234567L), (1, 30000000000L) AS t(n, p)").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(E.oracle_sql()["prj_1_ids"]).fetchall()
    assert sorted(map(tuple, E.queries()["prj_1_ids"](spark, str(tmp_path)).collect())) == sorted(want)
    whole = spark.range(1).select(Q.bout_id("D", F.lit("r"), F.lit(1), F.lit(30000000000)).alias("b")).first()["b"]
    assert whole == "D::r::well01::bout30000000000"


def test_blinding_round_trip(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(10)], "i int, label string")
    m = BL.blind_map(df, "label", 3, "C")
    codes = {r["label"]: r["code"] for r in m.collect()}
    assert sorted(codes.values()) == ["C01", "C02", "C03", "C04"]
    blind = BL.apply_blind_map(df, "label", m)
    assert not {r["label"] for r in blind.collect()} & set(codes)
    assert sorted(map(tuple, BL.unblind(blind, "label", m).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="no blind code"):
        BL.apply_blind_map(spark.createDataFrame([("zz",)], "label string"), "label", m).collect()


def test_lookup_problems(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "k string")
    vals = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4), ("d", 5)], "k string, v int")
    joined, bad = Q.lookup(rows, vals, "k")
    assert {r["k"]: r["problem"] for r in bad.collect()} == {"b": "reused", "c": "missing", "d": "ambiguous"}
    assert sorted(r["v"] for r in joined.collect()) == [1, 2, 2]
