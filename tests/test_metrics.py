"""Metrics against brute force and literal cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.operators import agreement as G
from boutwise.operators import clustering as C
from boutwise.operators import decisions as D
from boutwise.operators import effects as X
from boutwise.operators import probes as P
from boutwise.operators import quality as Q


def labels(spark, a, b):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "id long, a long, b long")


def test_alignment_literal(spark):
    df = labels(spark, [0, 0, 1, 1, 2, 2], [2, 2, 0, 0, 1, 1])
    ct = G.contingency(df.withColumn("g", F.lit(1)), "a", "b", ["g"])
    got = {r["b"]: r["aligned"] for r in G.align(ct, "a", "b", 3, ["g"]).collect()}
    assert got == {2: 0, 0: 1, 1: 2}
    assert abs(G.measures(ct, "a", "b", ["g"]).first()["ari"] - 1) < 1e-12


def test_assignment_is_lexicographic_optimum():
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = rng.integers(0, 4, (5, 5))
        best = max(itertools.permutations(range(5)), key=lambda p: (sum(m[i, p[i]] for i in range(5)), [-x for x in p]))
        assert G.best_assignment(m) == list(best)


def test_assignment_of_large_matrices():
    """200 labels in under a second each: a hidden permutation, many ties, all cells equal."""
    import time

    rng = np.random.default_rng(2)
    hidden = rng.permutation(200)
    m = rng.integers(0, 50, (200, 200))
    m[np.arange(200), hidden] += 10**12
    t = time.time()
    assert G.best_assignment(m) == hidden.tolist()
    assert G.best_assignment(np.full((200, 200), 7)) == list(range(200))
    few = rng.integers(0, 2, (200, 200))
    got = G.best_assignment(few)
    assert sorted(got) == list(range(200)) and few[np.arange(200), got].sum() == 200
    assert time.time() - t < 3
    assert G.best_assignment(np.zeros((0, 0))) == []
    with pytest.raises(ValueError):
        G.best_assignment(np.zeros((2, 3)))


def test_unmatched_candidates_get_fresh_ids(spark):
    df = labels(spark, [0, 0, 1, 1, 1], [0, 0, 1, 1, 2])
    got = {r["b"]: r["aligned"] for r in G.align(G.contingency(df, "a", "b"), "a", "b", 2, []).collect()}
    assert got[0] == 0 and got[1] == 1 and got[2] == 2


def test_constant_labelings(spark):
    one = G.measures(G.contingency(labels(spark, [1, 1, 1], [5, 5, 5]), "a", "b"), "a", "b").first()
    assert (one["ari"], one["nmi"], one["v_measure"], one["h_a_given_b"]) == (1.0, 1.0, 1.0, 0.0)
    half = G.measures(G.contingency(labels(spark, [1, 2, 1, 2], [5, 5, 5, 5]), "a", "b"), "a", "b").first()
    assert half["nmi"] == 0.0 and half["ari"] == 0.0 and half["homogeneity"] == 0.0 and half["completeness"] == 1.0
    assert G.cramers_v(G.contingency(labels(spark, [1, 2], [5, 5]), "a", "b"), "a", "b").first()["cramers_v"] == 0.0


def test_expected_mi_by_enumeration(spark):
    a, b = [0, 0, 0, 1, 1, 2], [0, 1, 1, 1, 0, 0]

    def mi(x, y):
        n = len(x)
        return sum(
            c / n * math.log(c * n / (x.count(i) * y.count(j)))
            for i in set(x) for j in set(y) if (c := sum(1 for p, q in zip(x, y) if (p, q) == (i, j)))
        )

    perms = list(itertools.permutations(b))
    want = sum(mi(a, list(p)) for p in perms) / len(perms)
    got = G.expected_mi(G.contingency(labels(spark, a, b), "a", "b"), "a", "b").first()["emi"]
    assert abs(got - want) < 1e-12


def test_expected_mi_of_large_margins(spark):
    # two balanced halves of n rows: expected MI tends to 1/(2n)
    n = 4_000_000_000
    ct = spark.createDataFrame([(0, 0, n // 4), (0, 1, n // 4), (1, 0, n // 4), (1, 1, n // 4)], "a int, b int, n long")
    assert abs(G.expected_mi(ct, "a", "b").first()["emi"] * 2 * n - 1) < 1e-2


def test_occupancy_literal(spark):
    df = spark.createDataFrame([("f1", 0), ("f1", 0), ("f2", 1), ("f2", 1), ("f3", 0), ("f3", 1)], "u string, c int")
    got = {r["c"]: r for r in G.unit_occupancy(df, "u", "c", 2).collect()}
    assert all(got[c]["units_with"] == 2 and got[c]["median"] == 0.5 for c in (0, 1))


def test_js_identical_and_disjoint(spark):
    df = spark.createDataFrame([(1, "x", 4), (2, "x", 9), (3, "y", 5)], "s long, c string, n long")
    got = {(r["seed_a"], r["seed_b"]): r["js_similarity"] for r in G.js_similarity(df, "s", "c", [1, 2, 3]).collect()}
    assert abs(got[(1, 2)] - 1) < 1e-12 and abs(got[(1, 3)]) < 1e-12


def test_entropy_normalisers(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0)], "k string, n long")
    val = lambda **k: G.entropy(df, **k).first()["normalized_entropy"]
    assert abs(val() - 1) < 1e-12
    assert abs(val(normaliser="listed") - math.log(2) / math.log(3)) < 1e-12
    assert abs(val(normaliser="size", size=8) - math.log(2) / math.log(8)) < 1e-12


@pytest.mark.parametrize("tiles", [1, 3])
def test_silhouette_brute_force(spark, tiles):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    lab = np.array([0] * 30 + [1] * 29 + [2])
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(60)], "id long, v array<double>, c long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = {r["id"]: r["s"] for r in C.silhouette_rows(df, "id", "v", "c", tiles=tiles).collect()}
    assert np.allclose([got[i] for i in range(60)], want)


def test_silhouette_of_one_cluster(spark):
    df = spark.createDataFrame([(i, [float(i)], 0) for i in range(5)], "id long, v array<double>, c long")
    assert C.silhouette(df, "id", "v", "c", tiles=1).first()["silhouette"] is None
    assert C.silhouette(df, "id", "v", "c", tiles=1, fill=-1.0).first()["silhouette"] == -1.0


@pytest.mark.parametrize("seed,units,top", [(1, 60, 4), (2, 200, 40), (3, 120, 15)])
def test_self_consistency_against_all_pairs(spark, seed, units, top):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, top, (units, 4)) * np.where(rng.random((units, 1)) < 0.3, 7, 1)
    counts[counts.sum(axis=1) == 0, 0] = 1
    counts[5] = counts[2] * 2  # equal shares, another size
    rows = [(u, c) for u in range(units) for c in range(4) for _ in range(int(counts[u, c]))]
    df = spark.createDataFrame(rows, "u long, c int")
    h = counts / counts.sum(axis=1, keepdims=True)
    thin = counts - np.floor(counts * 0.1)
    q = thin / thin.sum(axis=1, keepdims=True)
    d = np.sqrt(((q[:, None] - h[None]) ** 2).sum(axis=2))
    got = G.self_consistency(df, "u", "c", [0, 1, 2, 3]).first()
    assert got["units"] == units and abs(got["accuracy"] - (d.argmin(axis=1) == np.arange(units)).mean()) < 1e-12
    both = G.unit_histograms(df, "u", "c", [0, 1, 2, 3])
    first = both.dropDuplicates(["h"])
    met = G.rivals(first, "u", 4)
    near = {(r["u"], r["other"]) for r in met.collect()}
    kept = [r["u"] for r in first.collect()]
    assert {(a, b) for a in kept for b in kept if a != b and 0 < d[a, a] and d[a, b] <= d[a, a]} <= near
    if top == 40:
        assert met.count() < 0.2 * len(kept) ** 2


def test_selection_score_literal(spark):
    r = spark.range(1).select(C.selection_score(F.lit(0.5), F.lit(1.0), F.lit(0.05), F.lit(0)).alias("s")).first()["s"]
    assert abs(r - 0.7) < 1e-12


def test_kruskal_and_tail(spark):
    df = spark.createDataFrame([(float(v), g) for g, vs in {"a": [1, 2, 2], "b": [2, 5, 6], "c": [9, 9, 4]}.items() for v in vs], "v double, g string")
    r = X.kruskal_wallis(df, "v", "g").first()
    ranks = {1: 1, 2: 3, 4: 5, 5: 6, 6: 7, 9: 8.5}
    groups = {"a": [1, 2, 2], "b": [2, 5, 6], "c": [9, 9, 4]}
    h = 12 / 90 * sum(sum(ranks[v] for v in g) ** 2 / 3 for g in groups.values()) - 30
    h /= 1 - ((27 - 3) + (8 - 2)) / (729 - 9)
    assert abs(r["h"] - h) < 1e-9
    assert abs(r["p_value"] - math.exp(-h / 2)) < 1e-9  # two degrees of freedom
    t = spark.createDataFrame([(3.841458820694124, 1.0), (0.0, 1.0), (200.0, 3.0)], "x double, k double").select(X.chi2_tail("x", "k").alias("p")).collect()
    assert abs(t[0]["p"] - 0.05) < 1e-9 and t[1]["p"] == 1.0 and 0 < t[2]["p"] < 1e-40


def test_eta_squared_skips_missing(spark):
    rows = [(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0), (1, float("nan")), (0, None)]
    df = spark.createDataFrame(rows, "c int, v double")
    e = X.effect_sizes(X.group_moments(df, "c", ["v"])).first()
    assert abs(e["eta_squared"] - 16 / 20) < 1e-12 and e["n"] == 4
    flat = X.effect_sizes(X.group_moments(spark.createDataFrame([(0, 2.0), (1, 2.0)], "c int, v double"), "c", ["v"])).first()
    assert flat["eta_squared"] == 0.0 and flat["standardized_mean_range"] == 0.0


def test_profiles_keep_empty_clusters(spark):
    df = spark.createDataFrame([(0, 1.0), (2, 5.0), (2, 7.0)], "cluster int, v double")
    got = {r["cluster"]: (r["n"], r["mean"], r["median"]) for r in X.profiles(df, "cluster", ["v"], 3).collect()}
    assert got == {0: (1, 1.0, 1.0), 1: (0, None, None), 2: (2, 6.0, 6.0)}


def test_spearman_guards(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("r", 1.0, 9.0), ("r", 2.0, 8.0), ("r", 3.0, 7.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in X.spearman(df, "x", "y", ["g"]).collect()}
    assert got["s"] is None and got["c"] is None and abs(got["r"] + 1) < 1e-12


def test_directional_mode_order(spark):
    df = spark.createDataFrame([(0, "negative"), (0, "positive"), (1, "neutral"), (1, "negative"), (2, "missing")], "cluster int, direction string")
    got = {r["cluster"]: (r["modal_direction"], r["consistency"]) for r in X.directional_consistency(df).collect()}
    assert got == {0: ("positive", 0.5), 1: ("negative", 0.5), 2: ("missing", 0.0)}


def test_scores_of_unseen_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "z")], "truth string, pred string")
    r = P.classification_scores(df).first()
    assert abs(r["balanced_accuracy"] - 0.25) < 1e-12 and abs(r["macro_f1"] - (2 / 3 + 0 + 0) / 3) < 1e-12 and r["chance"] == 0.5


@pytest.mark.parametrize("v,band,r2", [(0.75, "strong", "very_high"), (0.5, "moderate", "high"), (0.25, "weak", "moderate"), (0.2499, "poor", "low")])
def test_bands(spark, v, band, r2):
    r = spark.range(1).select(Q.ari_band(F.lit(v)).alias("a"), Q.r2_band(F.lit(v)).alias("b")).first()
    assert (r["a"], r["b"]) == (band, r2)


def test_claims(spark):
    m = spark.createDataFrame([(0.2, 0.31, 0.36, None)], "cross_seed_ari double, baseline_ari double, identity_v double, context_v double")
    m = m.withColumns({c: F.lit(0.3) for c in ("nonlinear_ba", "speed_eta", "speed_ba", "primary_eta", "primary_rho", "turn_eta", "turn_rho", "turn_directions")})
    got = {r["claim"]: r["status"] for r in D.assess(m, D.CLAIMS_SET1).collect()}
    assert got["general_ssl_k8_structure"] == "WEAKENED" and got["baseline_and_ssl_organizations_differ"] == "WEAKENED"
    assert got["low_fish_identity_leakage"] == "CONTRADICTED" and got["low_context_leakage"] == "NOT_TESTABLE"
    assert got["eight_clusters_are_distinct_novel_behaviors"] == "NOT_TESTABLE" and got["long_cs_primary_interpretation"] == "WEAKENED"


def test_null_categories_stay_in_every_sum(spark):
    rows = [("x", "p"), ("x", "p"), ("y", "q"), ("y", None), (None, "q"), (None, None), ("x", "q")]
    ct = G.contingency(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    cells = G.with_margins(ct, "a", "b")
    assert cells.agg(F.sum("n")).first()[0] == 7 and cells.count() == ct.count()
    v = G.cramers_v(ct, "a", "b").first()
    assert (v["n"], v["n_a"], v["n_b"]) == (7, 3, 3)
    assert G.within(ct, "a", "b").count() == ct.count()


def test_a_label_outside_the_range_is_an_error(spark):
    with pytest.raises(Exception, match="outside"):
        C.cluster_counts(spark.createDataFrame([(0,), (5,)], "cluster long"), 3).collect()
