"""Fits, bootstrap, embeddings, augmentation, sequences and streams: planted structure and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.operators import augment as AU
from boutwise.operators import bootstrap as BS
from boutwise.operators import clustering as C
from boutwise.operators import decisions as D
from boutwise.operators import embedding as E
from boutwise.operators import linear as L
from boutwise.operators import probes as P
from boutwise.operators import sequences as SQ
from boutwise.plans import selection as SEL
from boutwise.streaming import incremental as ST


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    centre = np.array([[0, 0, 0], [8, 0, 0], [0, 9, 0]], dtype=float)
    rows = [(i, i % 3, (centre[i % 3] + rng.normal(0, 0.5, 3)).tolist(), i % 20) for i in range(240)]
    return spark.createDataFrame(rows, "id long, truth int, v array<double>, unit int").cache(), rows


def ari(df, a, b):
    from boutwise.operators import agreement as G

    return G.measures(G.contingency(df, a, b), a, b).first()["ari"]


def test_kmeans_and_mixture_recover_blobs(spark, blobs):
    df, _ = blobs
    km = C.fit_kmeans(df, "v", 3, 1, n_init=3)
    assert ari(C.assign(df, "v", km, ["id", "truth"]), "truth", "cluster") == 1.0
    mix = C.fit_gmm(df, "v", 3, 1, n_init=2)
    p = C.predict_gmm(df, "v", mix, ["truth"])
    assert ari(p, "truth", "cluster") == 1.0 and mix.parameters == 9 + 18 + 2
    assert abs(p.agg(F.sum("log_lik")).first()[0] - mix.log_likelihood) < 0.05 * abs(mix.log_likelihood)


def test_lloyd_cost_falls(spark, blobs):
    df, _ = blobs
    start = C.hashed_centres(df, "id", "v", 3, 5)
    costs = [C.lloyd(df, "v", start, n).cost for n in (1, 2, 4)]
    assert costs[0] >= costs[1] >= costs[2]
    m = C.lloyd(df, "v", start, 2)
    assert np.allclose(C.from_frozen(C.frozen_table(spark, m)).values, m.values)


def test_pca_and_covariance(spark, blobs):
    df, rows = blobs
    x = np.array([r[2] for r in rows])
    cov = L.to_matrix(L.covariance(df, "v"), 3)
    assert np.allclose(cov, np.cov(x.T, ddof=0))
    m = L.fit_pca(df, "v", 0.95)
    w = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(m.ratios, w / w.sum()) and m.components.shape[1] == m.needed(0.95)
    pc = np.array([r["pc"] for r in m.project(df, "v").select("pc").collect()])
    assert np.allclose(pc.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(pc.var(axis=0), w[: pc.shape[1]])


def test_repeated_fits_are_stable_on_blobs(spark, blobs):
    df, _ = blobs
    assert SEL.fit_stability(df, "id", "v", "kmeans", 3, 1, 2, 1000, n_init=2).first()["stability"] == 1.0


def test_bootstrap_weights(spark, blobs):
    df, _ = blobs
    w = BS.unit_weights(df, "unit", 30, 4).toPandas()
    assert (w.groupby("rep")["weight"].sum() == 20).all() and w["rep"].nunique() == 30
    again = BS.unit_weights(df.repartition(3), "unit", 30, 4).toPandas()
    key = ["rep", "unit"]
    assert w.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_bootstrap_expansion_literal(spark):
    rows = spark.createDataFrame([(0, "f1"), (1, "f1"), (2, "f2"), (3, "f3"), (4, "f3")], "i int, u string")
    w = spark.createDataFrame([(0, "f1", 2), (0, "f3", 1)], "rep long, u string, weight long")
    got = sorted((r["i"], r["weight"]) for r in BS.expand(rows, w, "u").collect())
    assert got == [(0, 2), (1, 2), (3, 1), (4, 1)]


def test_interval_literal(spark):
    r = BS.interval(spark.range(100).select(F.col("id").cast("double").alias("value"))).first()
    assert np.allclose([r["low"], r["median"], r["high"]], np.quantile(np.arange(100), [0.025, 0.5, 0.975]))


def test_bootstrap_of_equal_labels_is_one(spark, blobs):
    df, _ = blobs
    vals = [r["value"] for r in BS.bootstrap_ari(df.withColumn("copy", F.col("truth") + 5), "unit", "truth", "copy", 5, 1).collect()]
    assert np.allclose(vals, 1.0)


def test_refit_bootstrap_on_blobs(spark, blobs):
    df, _ = blobs
    ref = C.fit_kmeans(df, "v", 3, 1, n_init=3)
    got = BS.bootstrap_refit(df, df, "unit", "id", "v", ref, 2, 3).collect()
    assert len(got) == 2 and all(0 <= r["agreement"] <= 1 for r in got)


def test_probes_find_planted_signal(spark, blobs):
    df, _ = blobs
    f = df.select("id", "truth", *[F.col("v")[i].alias(f"x{i}") for i in range(3)])
    a, b = f.where("id % 4 > 0"), f.where("id % 4 = 0")
    for pred in (P.logistic_probe(a, b, ["x0", "x1"], "truth", max_iter=20), P.forest_probe(a, b, ["x0", "x1"], "truth", trees=5)):
        assert P.classification_scores(pred).first()["balanced_accuracy"] > 0.99
    noise = P.classification_scores(P.logistic_probe(a, b, ["x2"], "truth", max_iter=20)).first()
    assert noise["balanced_accuracy"] < 0.7
    assert P.holdout_probe(f, "id", "truth", ["x0", "x1"], 3, max_iter=20).first()["accuracy"] > 0.99


def test_ridge_matches_closed_form(spark, blobs):
    df, rows = blobs
    f = df.select(*[F.col("v")[i].alias(f"x{i}") for i in range(3)]).withColumn("y", F.col("x0") * 2 - F.col("x1") + 3)
    x = np.array([r[2] for r in rows])
    y = 2 * x[:, 0] - x[:, 1] + 3
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(3), xc.T @ yc)
    beta, b0 = P.fit_ridge(f, ["x0", "x1", "x2"], "y", 2.5)
    assert np.allclose(beta, want) and abs(b0 - (y.mean() - x.mean(0) @ want)) < 1e-9
    assert P.ridge_probe(f, f, ["x0", "x1", "x2"], "y").first()["r2"] > 0.999


def test_encoder_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    n, t = 3, 11
    x = rng.normal(size=(n, 3, t)).astype(np.float32)
    w = E.encoder_weights(1, channels=(3, 4, 5), kernels=(5, 3), dim=6)
    df = spark.createDataFrame([(i, *[x[i, c].tolist() for c in range(3)]) for i in range(n)], "id int, sin_angle array<float>, cos_angle array<float>, speed array<float>")
    got = np.array([r["embedding"] for r in E.encode(df, w).orderBy("id").collect()])
    from math import erf

    want = []
    for i in range(n):
        y = x[i].astype(float)
        for s in (0, 1):
            k = w[f"conv{s}"]
            pad = k.shape[2] // 2
            p = np.pad(y, ((0, 0), (pad, pad)))
            z = np.array([[(p[:, j : j + k.shape[2]] * k[o]).sum() for j in range(t)] for o in range(len(k))]) / np.sqrt(1 + 1e-5)
            y = np.vectorize(lambda v: 0.5 * v * (1 + erf(v / np.sqrt(2))))(z)
        want.append(w["linear"] @ y.mean(axis=1) + w["bias"])
    assert np.allclose(got, want, atol=1e-4)


def test_contrastive_loss_properties(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(8, 4))
    rows = [(0, a[i].tolist(), a[i].tolist()) for i in range(8)] + [(1, a[i].tolist(), a[(i + 3) % 8].tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "batch long, a array<double>, b array<double>")
    got = {r["batch"]: r["loss"] for r in E.contrastive_loss(df, "batch", "a", "b").collect()}
    swap = {r["batch"]: r["loss"] for r in E.contrastive_loss(df, "batch", "b", "a").collect()}
    assert got[0] < got[1] and all(abs(got[k] - swap[k]) < 1e-9 for k in got)
    with pytest.raises(Exception, match="at most"):
        E.contrastive_loss(df, "batch", "a", "b", max_batch=4).collect()


def test_views_are_reproducible_and_bounded(spark):
    rows = [(i, [1.0] * 175, [2.0] * 175, [float(j + 1) for j in range(175)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row int, sin_angle array<float>, cos_angle array<float>, speed array<float>")
    seed = AU.view_seed(20260822, 1, F.col("row"))
    one, two = AU.two_views(df, seed).toPandas(), AU.two_views(df.repartition(5), seed).toPandas().sort_values("row").reset_index(drop=True)
    assert (one.sort_values("row").reset_index(drop=True)[["a_start", "a_size", "a_group", "b_start"]].fillna("-") == two[["a_start", "a_size", "a_group", "b_start"]].fillna("-")).all().all()
    assert one["a_size"].max() == 17 and (one["a_start"] + one["a_size"] <= 175).all()
    assert 0.35 < (one["a_size"] > 0).mean() < 0.65 and 0.15 < one["a_group"].notna().mean() < 0.35
    m = AU.view_metrics(AU.two_views(df, seed), ["row"], "a").toPandas().merge(one, on="row")
    plain = m[m["a_group"].isna()]
    assert (plain["changed_steps"] == plain["a_size"]).all() and (plain["changed_elements"] == 3 * plain["a_size"]).all()


def test_markov_chain_motifs(spark):
    df = spark.createDataFrame([("s", i, "ab"[i % 2]) for i in range(101)], "k string, position int, l string")
    tr = {(r["prev"], r["next"]): r["p"] for r in SQ.transitions(df, ["k"], "l").collect()}
    assert tr == {("a", "b"): 1.0, ("b", "a"): 1.0}
    t = SQ.expected_frequency(SQ.motifs(df, ["k"], "l", 3), SQ.transitions(df, ["k"], "l"), SQ.start_distribution(df, "l"))
    r = {"".join(x["motif"]): x for x in SQ.markov_score(t).collect()}
    assert r["aba"]["windows"] == 99 and abs(r["aba"]["expected"] - 51 / 101) < 1e-12 and r["aba"]["neg_log10_p"] < 0.1


def test_compare_usage_with_a_missing_motif(spark):
    a = spark.createDataFrame([(["x"], 3, 4, 0.75), (["y"], 1, 4, 0.25)], "motif array<string>, n long, windows long, frequency double")
    b = spark.createDataFrame([(["x"], 2, 4, 0.5), (["z"], 2, 4, 0.5)], "motif array<string>, n long, windows long, frequency double")
    got = {r["motif"][0]: r["score"] for r in SQ.compare_usage(a, b).collect()}
    assert got["z"] is None and got["x"] > 0 and got["y"] > 0


def bout_stream(spark, folder, batches):
    """Batches of (unit, start, end) in seconds, one file each; a start of None is a heartbeat at the end."""
    schema = "n int, k long, start double, end double"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(i, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return s.withColumn("at", F.timestamp_micros((F.coalesce("start", "end") * 1_000_000 + 1.7e15).cast("long")))


def test_stream_flags_late_rows(spark, tmp_path):
    s = bout_stream(spark, tmp_path / "in", [
        [(1, 0.0, 1.0), (1, 3.0, 4.0), (2, 0.0, 9.0)], [(2, 10.0, 11.0)], [(1, 2.0, 2.5), (1, 6.0, 7.0), (1, 20.0, 21.0)], [(3, None, 1000.0)], [(2, 1.0, 2.0)], [(2, 1002.0, 1003.0)]])
    out = ST.online_intervals(s, "k", "at", "5 seconds")
    assert out.isStreaming
    got = {(r["k"], r["start"]): (r["interval"], r["late"]) for r in ST.run_to_table(out, "append", "late").collect()}
    assert got == {(1, 0.0): (None, False), (1, 3.0): (2.0, False), (2, 0.0): (None, False), (2, 10.0): (1.0, False), (1, 2.0): (None, True), (1, 6.0): (2.0, False),
                   (1, 20.0): (13.0, False), (2, 1.0): (None, True)}


def test_stream_forgets_idle_units(spark, tmp_path):
    batches = [[(1, 0.0, 1.0)], [(2, 100.0, 101.0)], [(2, 110.0, 111.0)], [(1, 120.0, 121.0), (2, 121.0, 122.0)], [(9, None, 500.0)], [(9, None, 600.0)]]
    for name, forget, first in (("a", None, 119.0), ("b", 20_000, None)):
        out = ST.online_intervals(bout_stream(spark, tmp_path / name, batches), "k", "at", "1 second", forget)
        got = {(r["k"], r["start"]): r["interval"] for r in ST.run_to_table(out, "append", "forget").collect()}
        assert got == {(1, 0.0): None, (2, 100.0): None, (2, 110.0): 9.0, (1, 120.0): first, (2, 121.0): 10.0}


def test_stream_in_one_or_many_batches(spark, tmp_path):
    """Bouts in any order within the delay give the same rows whatever the batches are."""
    rng = np.random.default_rng(5)
    start = np.sort(rng.uniform(0, 900, 600))
    rows = [(int(k), float(s), float(s) + 0.2) for k, s in zip(rng.integers(0, 4, 600), start)]
    want, last = set(), {}
    for k, s, e in rows:
        want.add((k, s, s - last[k] if k in last else None, False))
        last[k] = e
    mixed = [r for lo in range(0, 600, 12) for r in rng.permutation(np.array(rows[lo:lo + 12], object)).tolist()]
    beat = [(0, None, 5000.0)]
    for name, size in (("one", 600), ("many", 120)):
        batches = [[tuple(r) for r in mixed[lo:lo + size]] for lo in range(0, 600, size)]
        out = ST.online_intervals(bout_stream(spark, tmp_path / name, [*batches, beat]), "k", "at", "60 seconds")
        assert {(r["k"], r["start"], r["interval"], r["late"]) for r in ST.run_to_table(out, "append", name).collect()} == want


def test_geometry_of_equal_embeddings(spark, blobs):
    df, _ = blobs
    per = df.select("id", "v", F.lit(1).cast("long").alias("seed")).unionByName(df.select("id", F.transform("v", lambda x: x * 3).alias("v"), F.lit(2).cast("long").alias("seed")))
    pairs = E.sampled_pairs(df, "id", 100, 50, 1)
    assert pairs.where("a = b").count() == 0 and pairs.count() == 50
    r = E.geometry_similarity(E.pair_distances(pairs, per, "id", "v"), [1, 2]).first()
    assert abs(r["rho"] - 1) < 1e-9 and r["n"] == 50


def test_unordered_hot_unit_has_no_late_rows(spark, tmp_path):
    """One unit, many bouts that come unordered in one batch; a plain session without a state store suffices."""
    n = 40_000
    rows = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 4.0).alias("end")).orderBy(F.xxhash64("start"))
    rows = rows.union(spark.createDataFrame([(2, None, 1e9)], "k int, start double, end double"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    s = s.withColumn("at", F.timestamp_seconds(F.coalesce("start", "end")))
    got = ST.run_to_table(ST.online_intervals(s, "k", "at", "1 minute"), "append", "hot")
    assert got.count() == n and got.where("late").count() == 0 and got.where("interval = 6.0").count() == n - 1


def test_claims_come_from_a_table(spark):
    rules = spark.createDataFrame(
        [("a", "SUPPORTED", "m", ">=", 0.3), ("a", "WEAKENED", "m", ">=", 0.1), ("b", "NOT_TESTABLE", None, None, None)],
        "claim string, status string, metric string, op string, limit double",
    )
    got = {r["claim"]: r["status"] for r in D.assess(spark.createDataFrame([(0.2,)], "m double"), D.claims_from(rules)).collect()}
    assert got == {"a": "WEAKENED", "b": "NOT_TESTABLE"}


def test_ragged_and_missing_vectors_are_errors(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], None]):
        df = spark.createDataFrame([(v,) for v in bad], "v array<double>").coalesce(1)
        with pytest.raises(Exception, match="components"):
            L.gram(df, "v", 2).collect()


def test_missing_labels_count_as_labels(spark):
    pred = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None), (None, None)], "truth string, pred string")
    got = P.classification_scores(pred).first()
    assert got["n"] == 4
    t = SQ.transitions(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "a"), (1, 3, "b")], "k long, position long, l string"), ["k"], "l")
    assert t.agg(F.sum("n")).first()[0] == 3


def test_recoverability_scores_all_held_out_rows(spark):
    from boutwise.operators import probes

    d = spark.createDataFrame([(i, float(i % 2) + i / 1000, "ab"[i % 2]) for i in range(40)], "id long, x double, label string")
    r = probes.recoverability(d, "id", ["x"], "label", 10, 3, max_iter=5).first()
    assert r["n"] == 8


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(BS, "DRAWS", 1000)
    df = spark.range(90).selectExpr("id AS unit").coalesce(1)
    w = BS.unit_weights(df, "unit", 100, 4)
    assert "REPARTITION_BY_NUM" in w._jdf.queryExecution().executedPlan().toString()  # 9 tasks
    got = {r["rep"]: r["n"] for r in w.groupBy("rep").agg(F.sum("weight").alias("n")).collect()}
    assert got == {r: 90 for r in range(100)}


def test_encoder_rows_stay_in_cache():
    """A batch needs memory for a few rows' layers only, in single precision, and gives what one convolution after the other gives."""
    import math
    import tracemalloc

    w, x = E.encoder_weights(3), np.random.default_rng(2).normal(0, 1, (400, 3, 60)).astype(np.float32)
    rng = np.random.default_rng(4)
    for k in ("bn0", "bn1", "bn2"):
        w[k] = (w[k] + rng.uniform(0, 0.5, w[k].shape)).astype(np.float32)
    E.forward(x[:4], w)
    tracemalloc.start()
    got = E.forward(x, w)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000  # 400 rows of one layer alone have 12 million bytes
    tracemalloc.stop()
    y = x[7].astype(float)
    for i in range(3):
        k, bn = w[f"conv{i}"], w[f"bn{i}"]
        p = np.pad(y, ((0, 0), (k.shape[2] // 2, k.shape[2] // 2)))
        z = np.array([[(p[:, t:t + k.shape[2]] * f).sum() for t in range(60)] for f in k])
        z = (z - bn[2][:, None]) / np.sqrt(bn[3][:, None] + 1e-5) * bn[0][:, None] + bn[1][:, None]
        y = 0.5 * z * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    assert np.allclose(got[7], w["linear"] @ y.mean(axis=1) + w["bias"], atol=2e-6) and E.forward(x[:0], w).shape == (0, 64)


def test_waiting_bouts_are_packed(spark, tmp_path):
    """The state has packed numbers, not a list element per bout; rows without a start or time are left out, a missing end stays missing."""
    assert [f.split()[1] for f in ST.STATE.split(", ")][2:] == ["binary"] * 3
    rows = [(1, 0.0, 1.0), (1, 4.0, None), (1, 2.0, 3.0), (1, 6.0, 7.0), (1, None, 8.0), (2, None, 9000.0)]
    out = ST.online_intervals(bout_stream(spark, tmp_path / "in", [rows]), "k", "at", "1 second")
    got = [(r["start"], r["end"], r["interval"], r["late"]) for r in ST.run_to_table(out, "append", "packed").orderBy("start").collect()]
    assert [g[0] for g in got] == [0.0, 2.0, 4.0, 6.0] and [g[2] for g in got[:3]] == [None, 1.0, 1.0] and not any(g[3] for g in got)
