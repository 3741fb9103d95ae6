"""Fits in shared scans against plain loops over one fit at a time."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.operators import agreement as G
from boutwise.operators import bootstrap as BS
from boutwise.operators import clustering as C
from boutwise.operators import manyfits as M
from boutwise.operators.partials import vector_sum
from boutwise.plans import selection as SEL


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(4, 3)) * 4
    return np.concatenate([c + rng.normal(size=(40, 3)) for c in centre])


@pytest.fixture(scope="module")
def df(spark, rows):
    w = [[1.0, float(i % 2), float(i % 3)] for i in range(len(rows))]
    table = [(i, i % 10, x.tolist(), w[i]) for i, x in enumerate(rows)]
    return spark.createDataFrame(table, "id long, unit long, v array<double>, w array<double>").repartition(5).cache()


def lloyd(x, w, centres, max_iter=300, tolerance=1e-4):
    for _ in range(max_iter):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        n = np.bincount(best, w, len(centres))
        moved = np.array([(x[best == j] * w[best == j, None]).sum(axis=0) / n[j] if n[j] else centres[j] for j in range(len(centres))])
        shift = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max()
        centres = moved
        if shift <= tolerance:
            break
    return centres, (d.min(axis=1) * w).sum()


def test_kmeans_is_lloyd_of_each_fit(df, rows):
    data = M.prepared(df, "id", "v", "w")
    fits = [M.Fit(k, s, p) for k in (1, 2, 5) for s in (3, 4) for p in (None, 0, 1, 2)]
    begin = M.starts(data, 3, fits)
    got = M.kmeans(data, fits)
    for f, b, m in zip(fits, begin, got, strict=True):
        assert len(b) == f.k
        w = np.ones(len(rows)) if f.weight is None else np.array([[1.0, i % 2, i % 3][f.weight] for i in range(len(rows))])
        centres, cost = lloyd(rows, w, b)
        assert np.allclose(m.values, centres) and abs(m.cost - cost) < 1e-6 * max(1, cost)
    # weight 0 for all rows but the even ones, or none at all: same fit as without weights
    assert np.allclose(got[0].values, got[1].values)


def test_scans_do_not_grow_with_the_fits(df, monkeypatch):
    calls = []

    def counted(*a):
        calls.append(1)
        return vector_sum(*a)

    monkeypatch.setattr(M, "vector_sum", counted)
    data = M.prepared(df, "id", "v").cache()
    each = []
    for s in range(3):
        calls.clear()
        M.kmeans(data, [M.Fit(4, s)])
        each.append(len(calls))
    calls.clear()
    M.kmeans(data, [M.Fit(4, s) for s in range(3)] * 20)
    assert len(calls) == max(each)


def test_few_rows_deal_out_the_fits(df, monkeypatch):
    data = M.prepared(df, "id", "v", "w").cache()
    fits = [M.Fit(k, s, p) for k in (1, 2, 5) for s in (3, 4) for p in (None, 2)]
    calls = []
    monkeypatch.setattr(M, "vector_sum", lambda *a: calls.append(1) or vector_sum(*a))
    here = M.kmeans(data, fits), M.mixtures(data, fits)
    assert not calls  # no job per step
    monkeypatch.setattr(M, "IN_TASK", 160 * 6 - 1)  # three coordinates and three weights a row: one number too many
    there = M.kmeans(data, fits), M.mixtures(data, fits)
    assert calls
    for a, b in zip(here[0], there[0], strict=True):
        assert np.allclose(a.values, b.values) and abs(a.cost - b.cost) < 1e-8 * max(1, b.cost)
    for a, b in zip(here[1], there[1], strict=True):
        assert np.allclose(a.means, b.means) and np.allclose(a.covs, b.covs) and abs(a.log_likelihood - b.log_likelihood) < 1e-7 * abs(b.log_likelihood) and a.n == b.n
    each = []
    for many in ([M.Fit(4, s) for s in range(3)] * 20, [M.Fit(4, 0)], [M.Fit(4, 1)], [M.Fit(4, 2)]):
        calls.clear()
        M.kmeans(data, many)
        each.append(len(calls))
    assert each[0] == max(each[1:]) > 0
    nothing = M.prepared(df.withColumn("w", F.array(F.lit(0.0))), "id", "v", "w")
    with pytest.raises(ValueError):
        M.kmeans(nothing, [M.Fit(2, 1, 0)])


def test_a_row_between_two_centres_belongs_to_the_first():
    stack = M.Stack([np.array([[1.0, 0], [-1, 0], [1, 0]]), np.array([[0.0, 2], [0, -2], [9, 9]]), np.array([[3.0, 3]])])
    x = np.array([[0.0, 0], [1, 0], [-2, 0]])
    which, far = stack.choice(x)
    member, same = stack.member(M._with_one(x))
    assert which.tolist() == [[0, 0, 1], [0, 0, 0], [0, 0, 0]] and np.allclose(far, same)
    assert member[stack.place].T.tolist() == [[1, 0, 0, 1, 0, 0, 1], [1, 0, 0, 1, 0, 0, 1], [0, 1, 0, 1, 0, 0, 1]]


def test_densities_of_narrow_components_far_out():
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(30, 4)) * 1e-3 + 1e3, rng.normal(size=(30, 4))))
    chol = np.stack([np.eye(4) * 1e-3, np.linalg.cholesky(np.cov(x[30:].T))])
    weights, means, shift = np.array([0.5, 0.5]), np.stack([x[:30].mean(axis=0), x[30:].mean(axis=0)]), x.mean(axis=0)
    got = M._Densities([(weights, means, chol)], shift).log_density(x - shift, M._products(x - shift)).T
    want = C._log_density(x, weights, means, list(chol))
    assert np.allclose(got[:30, 0], want[:30, 0], atol=1e-6) and np.allclose(got[30:, 1], want[30:, 1], atol=1e-6)


def test_draws_do_not_depend_on_the_partitions(df):
    a, b = (M.starts(M.prepared(x, "id", "v"), 3, [M.Fit(3, 1), M.Fit(6, 2)]) for x in (df, df.repartition(2)))
    assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_few_different_rows(spark):
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id long, v array<double>")
    m = M.kmeans(M.prepared(same, "id", "v"), [M.Fit(4, 1)])[0]
    assert sorted(m.values.tolist()) == [[1.0, 0.0], [1.0, 1.0]] and m.cost == 0
    with pytest.raises(ValueError):
        M.starts(M.prepared(same.withColumn("w", F.array(F.lit(0.0))), "id", "v", "w"), 2, [M.Fit(2, 1, 0)])


def test_mixture_is_expectation_maximisation(df, rows):
    data = M.prepared(df, "id", "v")
    fits = [M.Fit(2, 1), M.Fit(4, 2)]
    starts = M.kmeans(data, fits, max_iter=30)
    for f, start, m in zip(fits, starts, M.mixtures(data, fits), strict=True):
        r = np.eye(f.k)[((rows[:, None] - start.values) ** 2).sum(axis=2).argmin(axis=1)]
        last = None
        for _ in range(100):
            n = r.sum(axis=0)
            mu = r.T @ rows / n[:, None]
            cov = [((rows - c) * r[:, j:j + 1]).T @ (rows - c) / n[j] + 1e-6 * np.eye(3) for j, c in enumerate(mu)]
            logp = np.stack([np.log(n[j] / len(rows)) - 0.5 * (np.einsum("ij,jk,ik->i", rows - mu[j], np.linalg.inv(cov[j]), rows - mu[j]) + np.linalg.slogdet(cov[j])[1] + 3 * np.log(2 * np.pi)) for j in range(f.k)], axis=1)
            top = logp.max(axis=1, keepdims=True)
            lse = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
            r = np.exp(logp - lse[:, None])
            if last is not None and abs(lse.mean() - last) < 1e-3:
                break
            last = lse.mean()
        assert abs(m.log_likelihood - lse.sum()) < 1e-5 * abs(lse.sum()) and np.allclose(m.means, mu, atol=1e-5) and abs(m.weights.sum() - 1) < 1e-9


def test_labels_counts_crossings_silhouettes(df, rows):
    data = M.prepared(df, "id", "v", "w")
    models = [*M.kmeans(data, [M.Fit(2, 1), M.Fit(4, 1)]), *M.mixtures(data, [M.Fit(3, 1)]), C.Centres(np.array([[0.0, 0, 0]]))]
    lab = M.labels(rows, models)
    assert [c.tolist() for c in M.counts(data, models)] == [np.bincount(lab[:, i], minlength=n).tolist() for i, n in enumerate((2, 4, 3, 1))]
    for weight, p in ((None, None), ([2, 2], 2)):
        w = np.ones(len(rows)) if p is None else np.arange(len(rows)) % 3
        tables = M.crossings(data, [(models[0], models[1]), (models[2], models[1])], weight)
        for t, (a, b) in zip(tables, ((0, 1), (2, 1))):
            want = np.zeros(t.shape)
            np.add.at(want, (lab[:, a], lab[:, b]), w)
            assert (t == want).all()
    sil = M.silhouettes(data, models, 1000)
    for i, m in enumerate(models[:2]):
        one = C.silhouette(C.assign(df, "v", m, ["id", "v"]), "id", "v", "cluster").first()["silhouette"]
        assert abs(sil[i] - one) < 1e-9
    assert np.isnan(sil[3])
    with pytest.raises(ValueError):
        M.silhouettes(data, models, 10)


def test_adjusted_rand(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    t = np.zeros((4, 3), np.int64)
    np.add.at(t, (a, b), 1)
    one = G.measures(G.contingency(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long"), "a", "b"), "a", "b").first()["ari"]
    assert abs(M.adjusted_rand(t) - one) < 1e-12 and M.adjusted_rand(np.array([[5]])) == 1.0


@pytest.mark.parametrize("direct", [0, 1 << 22])
def test_vector_sum_over_many_partitions(spark, monkeypatch, direct):
    monkeypatch.setattr("boutwise.operators.partials.DIRECT", direct)
    n = 70_000
    d = spark.range(n, numPartitions=70)
    size = 40_000  # two rows a task
    got = vector_sum(d, size, lambda: lambda b: np.bincount(b.column(0).to_numpy() % size, minlength=size).astype(float))
    assert (got == np.bincount(np.arange(n) % size, minlength=size)).all()
    assert (vector_sum(d.where("id < 0"), 3, lambda: lambda b: np.ones(3)) == 0).all()


def test_bootstrap_refit_is_a_plain_loop(df, rows):
    ref = C.Centres(rows[[0, 60, 100]])
    held = df.where("id % 4 = 0")
    got = {r["rep"]: r for r in BS.bootstrap_refit(df, held, "unit", "id", "v", ref, 3, 5, 20).collect()}
    w = {(r["rep"], r["unit"]): r["weight"] for r in BS.unit_weights(df, "unit", 3, 5).collect()}
    x = rows[::4]
    mine = ((x[:, None] - ref.values) ** 2).sum(axis=2).argmin(axis=1)
    for rep in range(3):
        weight = np.array([float(w.get((rep, i % 10), 0)) for i in range(len(rows))])
        one = df.withColumn("w", F.array(*[F.element_at(F.array(*[F.lit(float(w.get((rep, u), 0))) for u in range(10)]), (F.col("unit") + 1).cast("int"))]))
        begin = M.starts(M.prepared(one, "id", "v", "w"), 3, [M.Fit(3, 5 + rep, 0)])[0]
        centres, _ = lloyd(rows, weight, begin, 20)
        new = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        t = np.zeros((3, 3), np.int64)
        np.add.at(t, (mine, new), 1)
        best = max(sum(t[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3)))
        r = got[rep]
        assert r["rows"] == weight.sum() and abs(r["ari"] - M.adjusted_rand(t)) < 1e-9 and abs(r["agreement"] - best / len(x)) < 1e-9


def test_sweep_and_stability_of_a_subsample(df):
    two = [("kmeans", 4, 1), ("gmm", 2, 2)]
    whole = SEL.stabilities(df, "id", "v", two, 3, None)
    part = SEL.stabilities(df, "id", "v", two, 3, 80, n_init=2)
    assert whole[0] > 0.9 and all(-0.5 <= s <= 1 for s in part)
    c = SEL.candidates(df, df.where("id % 2 = 0"), "id", "v", ["kmeans", "gmm"], [2, 4], [1, 2], n_init=3, silhouette_rows=50)
    got = c.collect()
    assert len(got) == 8 and all(r["n_train"] == 160 and r["n_held"] == 80 and r["centre_gap"] < 1e-3 for r in got)
    best = C.select_best(c).first()
    assert best["k"] == 4 and best["silhouette"] > 0.4


def test_rows_of_one_file_are_dealt_to_all_tasks(spark, df):
    one = df.coalesce(1)
    data = M.prepared(one, "id", "v")
    sizes = data.rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 160 and max(sizes) < 60
    many = df.repartition(9 * M.SPLITS)  # few rows a split: no more vectors than cores
    assert M.prepared(many, "id", "v").rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_first_repeat_is_the_candidate(df, monkeypatch):
    seen = []
    fit_all = SEL.fit_all
    monkeypatch.setattr(SEL, "fit_all", lambda data, specs, n_init: seen.append(len(specs)) or fit_all(data, specs, n_init))
    args = (df, df.where("id % 2 = 0"), "id", "v", ["kmeans", "gmm"], [2, 3], [1])
    a = {(r["method"], r["k"]): r for r in SEL.candidates(*args, n_init=2).collect()}
    assert seen == [12]  # 4 candidates in 3 repeats, the first of which is the candidate itself
    b = {(r["method"], r["k"]): r for r in SEL.candidates(*args, n_init=2, stability_rows=159).collect()}
    assert seen == [12, 4, 12]
    for k, r in a.items():
        assert abs(r["silhouette"] - b[k]["silhouette"]) < 1e-9 and r["centre_gap"] < 1e-3
    alone = SEL.stabilities(df, "id", "v", [("kmeans", 3, 1)], 3, None, 2)[0]
    assert abs(a["kmeans", 3]["stability"] - alone) < 1e-9


def test_distances_of_near_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8)) + 1e4
    y = np.concatenate((x, x + 1e-7, rng.normal(size=(20, 8))))
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    from boutwise.operators.linear import distances

    got = distances(x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-11) and (np.diag(got) == 0).all()
