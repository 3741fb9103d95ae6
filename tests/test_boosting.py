"""Boosted trees: a round equals a plain best-first loop, hidden interactions are found, awkward rows have defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.operators import boosting as BO
from boutwise.operators import probes as P


def plain_tree(x, g, h, missing, max_leaves, min_leaf, l2):
    """Best-first growth by masks over all rows, one split at a time: leaf sums as a set of row sets."""
    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for cut in range(missing):
                for side in (False, True):
                    v = x[rows, f]
                    left = np.where(v == missing, side, v <= cut)
                    a, z = rows[left], rows[~left]
                    if min(len(a), len(z)) < min_leaf or min(h[a].sum(), h[z].sum()) < BO.LEAST_HESSIAN:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[z].sum() ** 2 / (h[z].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, a, z)
        return found

    everything = np.arange(len(x))
    leaves = [(everything, best(everything))]
    while len(leaves) < max_leaves:
        open_leaves = [i for i, (_, s) in enumerate(leaves) if s is not None]
        if not open_leaves:
            break
        i = max(open_leaves, key=lambda q: leaves[q][1][0])
        _, a, z = leaves.pop(i)[1]
        leaves += [(a, best(a)), (z, best(z))]
    return sorted(tuple(rows) for rows, _ in leaves)


@pytest.mark.parametrize("max_leaves", [2, 5, 9])
def test_growth_is_best_first(max_leaves):
    rng = np.random.default_rng(max_leaves)
    x = rng.integers(0, 7, (160, 3)).astype(np.uint8)  # 6 is the bin of missing values
    h = rng.uniform(0.05, 0.25, 160)
    g = rng.normal(0, 1, 160) + np.where(x[:, 0] > 2, 1.0, -1.0) * np.where(x[:, 1] > 3, 1.0, -0.3)
    grow = BO._Growing(max_leaves, 8, 1.0)
    scans = 0
    while wanted := grow.wanted():
        scans += 1
        at = grow.opened().place(x, 6)
        for i in wanted:
            hist = np.zeros((3, 7, 3))
            for r in np.flatnonzero(at == i):
                hist[np.arange(3), x[r]] += (g[r], h[r], 1.0)
            grow.learn(i, hist)
    tree = grow.final(0.5)
    at = tree.place(x, 6)
    got = sorted(tuple(np.flatnonzero(at == leaf)) for leaf in np.unique(at))
    assert got == plain_tree(x, g, h, 6, max_leaves, 8, 1.0)
    assert scans <= max_leaves
    for leaf in np.unique(at):
        rows = at == leaf
        assert abs(tree.value[leaf] + 0.5 * g[rows].sum() / (h[rows].sum() + 1.0)) < 1e-9


def frame(spark, n=3000):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(2001)) / 1000.0 - 1.0
    df = spark.range(0, n, 1, 6).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("c"))
    return df.withColumn("kind", F.when(F.abs("c") < 0.2, "mid").when(F.col("a") * F.col("b") > 0, "same").otherwise("apart"))


SMALL = {"rounds": 12, "rate": 0.3, "min_leaf": 20, "max_leaves": 8, "bins": 32}


def test_hidden_interaction_beats_the_linear_probe(spark):
    df = frame(spark, 2000).cache()
    a, b = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    boosted = P.classification_scores(P.boosted_probe(a, b, ["a", "b", "c"], "kind", **SMALL)).first()
    linear = P.classification_scores(P.logistic_probe(a, b, ["a", "b", "c"], "kind", max_iter=20)).first()
    assert boosted["accuracy"] > 0.9 > linear["accuracy"] + 0.2


def test_partitioning_and_slices_do_not_matter(spark, monkeypatch):
    df = frame(spark, 800)
    one = BO.fit(df.coalesce(1), ["a", "b"], "kind", **{**SMALL, "rounds": 2})
    monkeypatch.setattr(BO, "PER_SCAN", 1)  # one node a scan
    monkeypatch.setattr(BO, "CUT", 1)
    two = BO.fit(df.repartition(5), ["a", "b"], "kind", **{**SMALL, "rounds": 2})
    for x, y in zip(one.rounds, two.rounds, strict=True):
        for t, u in zip(x, y, strict=True):
            assert (t.feature == u.feature).all() and (t.cut == u.cut).all() and np.allclose(t.value, u.value)
    assert np.allclose(one.losses, two.losses) and one.losses[-1] < one.losses[0]


def test_noise_stops_early(spark):
    df = frame(spark, 1500).withColumn("coin", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)))
    m = BO.fit(df, ["a", "b"], "coin", rounds=60, rate=0.5, min_leaf=10, max_leaves=8, bins=16, patience=3)
    assert len(m.rounds) < 60 and not min(m.losses[-3:]) < m.losses[-4] - 1e-7


def test_awkward_rows(spark):
    rows = []
    for i in range(400):
        a = None if i % 4 == 0 else math.nan if i % 4 == 1 else float(i % 7)
        rows.append((i, a, 1.0, None, "gap" if i % 4 < 2 else "value"))
    df = spark.createDataFrame(rows + [(999, 1.0, 1.0, None, None)] * 5, "truth int, a double, constant double, nothing double, kind string")
    names = ["a", "constant", "nothing"]
    # without a key all rows of one value may be held back, and their side is then a tie
    m = BO.fit(df, names, "kind", key="truth", **{**SMALL, "rounds": 5})
    assert m.classes == ["gap", "value"]
    got = BO.predict(df.where("kind IS NOT NULL"), m, ["truth", "kind"]).collect()
    assert len(got) == 400 and all(r["pred"] == r["kind"] for r in got)
    # a column named like the output's, and one that is a feature as well
    assert P.boosted_probe(df, df, [*names, "truth"], "kind", **{**SMALL, "rounds": 2}).columns == ["truth", "pred"]
    assert BO.predict(df.where("false"), m, ["kind"]).collect() == []
    assert len(m.losses) == 6 and m.losses[-1] < m.losses[0]
    assert BO.fit(df, names, "kind", **{**SMALL, "rounds": 1}).classes == ["gap", "value"]
    one = BO.fit(df.where("kind = 'gap'"), names, "kind", **SMALL)
    assert {r["pred"] for r in BO.predict(df, one, ["kind"]).collect()} == {"gap"}
    same = BO.fit(spark.createDataFrame([(1.0, "x")] * 30 + [(1.0, "y")] * 60, "a double, kind string"), ["a"], "kind", **SMALL)
    assert same.rounds == [] and BO.predict(spark.createDataFrame([(5.0,)], "a double"), same, ["a"]).first()["pred"] == "y"
    with pytest.raises(ValueError):
        BO.fit(df.where("false"), names, "kind")
    with pytest.raises(ValueError):
        BO.fit(df, names, "kind", bins=256)


def test_nodes_grown_in_one_task_equal_those_of_summed_histograms(spark, monkeypatch):
    """Few scans a round where nodes are small, and the same trees whether a node's rows or its histograms are dealt out."""
    df, scans, scan = frame(spark, 1200), [], BO._scan
    monkeypatch.setattr(BO, "PER_TASK", 300)
    monkeypatch.setattr(BO, "_scan", lambda *a: scans.append(a) or scan(*a))
    fits, used = [], []
    for rows in (0, 300, 1 << 14):
        monkeypatch.setattr(BO, "IN_TASK", rows)
        scans.clear()
        fits.append(BO.fit(df, ["a", "b", "c"], "kind", **{**SMALL, "rounds": 3}))
        used.append(len(scans))
    assert used[2] == 4 and used[0] > used[1] > used[2]
    x = np.random.default_rng(3).integers(0, SMALL["bins"] + 1, (500, 3)).astype(np.uint8)
    for other in fits[1:]:
        for one, two in zip(fits[0].rounds, other.rounds, strict=True):
            for t, u in zip(one, two, strict=True):
                assert np.allclose(t.value[t.place(x, SMALL["bins"])], u.value[u.place(x, SMALL["bins"])], atol=1e-10)
        assert np.allclose(fits[0].losses, other.losses, atol=1e-10)


def test_small_tables_are_sent_once(spark, monkeypatch):
    """Rounds of a small table deal out no rows: blocks are not even made. The same trees come from scans."""
    df, blocks, made = frame(spark, 900), BO._blocks, []
    df = df.withColumn("b", F.when(F.col("id") % 7 > 0, F.col("b")))
    monkeypatch.setattr(BO, "_blocks", lambda *a: made.append(1) or blocks(*a))
    one = BO.fit(df, ["a", "b", "c"], "kind", key="id", **{**SMALL, "rounds": 4})
    assert not made
    monkeypatch.setattr(BO, "AT_HAND", 900 * 3 - 1)
    two = BO.fit(df, ["a", "b", "c"], "kind", key="id", **{**SMALL, "rounds": 4})
    assert made and len(one.rounds) == len(two.rounds) == 4 and np.allclose(one.losses, two.losses, atol=1e-10)
    x = np.random.default_rng(3).integers(0, SMALL["bins"] + 1, (500, 3)).astype(np.uint8)
    for r, q in zip(one.rounds, two.rounds, strict=True):
        for t, u in zip(r, q, strict=True):
            assert np.allclose(t.value[t.place(x, SMALL["bins"])], u.value[u.place(x, SMALL["bins"])], atol=1e-10)


def test_histograms_by_feature_or_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    x, g, h = rng.integers(0, 6, (4, 300)).astype(np.uint8), rng.normal(size=300), rng.uniform(0.05, 0.25, 300)
    rows = np.flatnonzero(rng.random(300) < 0.6)
    want = np.zeros((4, 6, 3))
    for r in rows:
        want[np.arange(4), x[:, r]] += (g[r], h[r], 1.0)
    for by in (1, 10_000):
        monkeypatch.setattr(BO, "BY_FEATURE", by)
        assert np.allclose(BO._histogram(x, rows, g, h, 6), want)


@pytest.mark.parametrize("max_leaves", [2, 5, 9])
@pytest.mark.parametrize("rows", [0, 30, 160])
def test_growth_by_differences_is_best_first(max_leaves, rows, monkeypatch):
    monkeypatch.setattr(BO, "DIFFERENCE", rows)
    rng = np.random.default_rng(max_leaves)
    x = rng.integers(0, 7, (160, 3)).astype(np.uint8)
    h = rng.uniform(0.05, 0.25, 160)
    g = rng.normal(0, 1, 160) + np.where(x[:, 0] > 2, 1.0, -1.0) * np.where(x[:, 1] > 3, 1.0, -0.3)
    at = BO.grown_whole(np.ascontiguousarray(x.T), np.arange(160), g, h, 6, max_leaves, 8, 1.0).final(0.5).place(x, 6)
    assert sorted(tuple(np.flatnonzero(at == leaf)) for leaf in np.unique(at)) == plain_tree(x, g, h, 6, max_leaves, 8, 1.0)
