"""Triangular factors of tall tables and the components from them."""

import numpy as np
import pytest

from boutwise.operators import linear as L


def table(spark, x, parts):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts)


def test_factor_of_many_tasks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 3
    r = L.triangular_factor(table(spark, x, 70), "v", 4)  # more tasks than are stacked at once
    whole = np.concatenate((np.ones((300, 1)), x), axis=1)
    assert np.allclose(r.T @ r, whole.T @ whole) and np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    m = L.principal_axes(table(spark, x, 3), "v")
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    assert m.n == 300 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scatter / 300, w[::-1])
    assert np.allclose(np.abs(m.components), np.abs(v[:, ::-1])) and (m.components[np.abs(m.components).argmax(axis=0), range(4)] > 0).all()


def test_small_variance_beside_a_large_mean(spark):
    """A summed product matrix has no digit of the small variance left."""
    rng = np.random.default_rng(2)
    small = rng.normal(size=400) * 1e-7
    x = np.stack([1e3 + rng.normal(size=400), 1e3 + small], axis=1)
    m = L.principal_axes(table(spark, x, 5), "v")
    exact = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(m.scatter, exact, rtol=1e-3)


def test_few_or_equal_rows(spark):
    one = L.principal_axes(table(spark, np.array([[1.0, 2.0, 3.0]]), 1), "v")
    assert one.n == 1 and np.allclose(one.mean, [1, 2, 3]) and not one.ratios.any()
    same = L.fit_pca(table(spark, np.ones((9, 2)), 2), "v", 0.95)
    assert np.allclose(same.scatter, 0, atol=1e-20) and same.components.shape[1] <= 2
    with pytest.raises(ValueError):
        L.triangular_factor(table(spark, np.ones((3, 2)), 1).where("id < 0"), "v", 2)
