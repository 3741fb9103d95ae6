"""Agreement of two labelings. Every measure starts from one contingency aggregate (category, cluster,
n); rows are counted once and all later steps touch only that small table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.expressions import clip01, pairs, plogp
from ..functions.ordering import join_nullsafe, quantiles
from .assignment import best_assignment
from .clustering import cluster_counts


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed cells (by, a, b, n); map-side partial counts keep hot cells small."""
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def dense_contingency(df: DataFrame, a: str, cluster: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells for all clusters 0..k-1 of every category, zeros included."""
    return cluster_counts(df, k, cluster, [*by, a]).select(*by, a, F.col(cluster).cast("bigint").alias(cluster), "n")


def _nlogn(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 0, n * F.ln(n)).otherwise(0.0)


def sums(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """All power and entropy sums of cells and margins in one pass: one row per `by`."""
    n = F.col("n")
    sets = [[*by, a, b], [*by, a], [*by, b]]
    g = ct.groupingSets(sets, *by, a, b).agg(F.grouping_id().alias("_g"), F.sum("n").alias("n"), F.max("n").alias("_top"))
    level = {"cell": 0, "a": 1, "b": 2}

    def over(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("_g") == level[kind], value).otherwise(0.0))

    return g.groupBy(*by).agg(
        over("cell", n.cast("double")).alias("n"),
        F.count_if((F.col("_g") == 1) & (n > 0)).alias("n_a"), F.count_if((F.col("_g") == 2) & (n > 0)).alias("n_b"),
        *[over(kind, pairs(n)).alias(f"pairs_{kind}") for kind in level],
        *[over(kind, _nlogn(n)).alias(f"nlogn_{kind}") for kind in level],
        over("a", F.col("_top").cast("double")).alias("top_a"), over("b", F.col("_top").cast("double")).alias("top_b"),
    )


def measures(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """ARI, MI, NMI, homogeneity (a given b), completeness, V, both conditional entropies, purities.
    a is the truth or category side, b the cluster side."""
    s = sums(ct, a, b, by)
    n = F.col("n")
    log_n = F.ln(n)
    ha = F.when(F.col("n_a") > 1, log_n - F.col("nlogn_a") / n).otherwise(0.0)
    hb = F.when(F.col("n_b") > 1, log_n - F.col("nlogn_b") / n).otherwise(0.0)
    mi = (F.col("nlogn_cell") - F.col("nlogn_a") - F.col("nlogn_b")) / n + log_n
    mi = F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), F.greatest(mi, F.lit(0.0))).otherwise(0.0)
    chance = F.coalesce(F.col("pairs_a") * F.col("pairs_b") / F.nullif(pairs(n), F.lit(0.0)), F.lit(0.0))
    room = (F.col("pairs_a") + F.col("pairs_b")) / 2.0 - chance
    ari = F.when(room == 0, 1.0).otherwise((F.col("pairs_cell") - chance) / F.nullif(room, F.lit(0.0)))
    base = s.withColumns({"_ha": ha, "_hb": hb, "mi": mi, "ari": ari})
    m, x, y = F.col("mi"), F.col("_ha"), F.col("_hb")
    hom = F.when(x == 0, 1.0).otherwise(m / F.nullif(x, F.lit(0.0)))
    com = F.when(y == 0, 1.0).otherwise(m / F.nullif(y, F.lit(0.0)))
    return base.select(
        *by, n.cast("bigint").alias("n"), F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"),
        "ari", "mi", x.alias("h_a"), y.alias("h_b"),
        F.when((F.col("n_a") <= 1) & (F.col("n_b") <= 1), 1.0).otherwise(m / F.nullif((x + y) / 2.0, F.lit(0.0))).alias("nmi"),
        hom.alias("homogeneity"), com.alias("completeness"),
        F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / F.nullif(hom + com, F.lit(0.0))).alias("v_measure"),
        F.when(x == 0, 0.0).otherwise((x - m) / F.nullif(x, F.lit(0.0))).alias("h_a_given_b"),
        F.when(y == 0, 0.0).otherwise((y - m) / F.nullif(y, F.lit(0.0))).alias("h_b_given_a"),
        (F.col("top_a") / n).alias("purity_a"), (F.col("top_b") / n).alias("purity_b"),
    )


def with_margins(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells with n_a, n_b and n_all; margins come from their own small aggregates, not from windows."""
    rows = ct.groupBy(*by, a).agg(F.sum("n").alias("n_a"))
    cols = ct.groupBy(*by, b).agg(F.sum("n").alias("n_b"))
    out = join_nullsafe(join_nullsafe(ct, rows, [*by, a]), cols, [*by, b])
    if by:
        return join_nullsafe(out, ct.groupBy(*by).agg(F.sum("n").alias("n_all")), list(by))
    return out.withColumn("n_all", ct.agg(F.sum("n")).scalar())


def cramers_v(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """chi2 over the dense grid and V without bias correction. An empty cell adds its expected count,
    so chi2 = N (sum n^2/(ab) - 1) over the observed cells alone."""
    cells = with_margins(ct.where(F.col("n") > 0), a, b, by)
    n = F.col("n").cast("double")
    g = cells.groupBy(*by).agg(
        F.sum(n * n / F.col("n_a") / F.col("n_b")).alias("_s"), F.max("n_all").alias("n"),
        F.countDistinct(F.struct(a)).alias("n_a"), F.countDistinct(F.struct(b)).alias("n_b"),
    )
    chi2 = F.greatest(F.col("n") * (F.col("_s") - 1.0), F.lit(0.0))
    dof = F.least(F.col("n_a"), F.col("n_b")) - 1
    v = F.when(dof <= 0, 0.0).otherwise(F.sqrt(chi2 / F.col("n") / F.nullif(dof, F.lit(0))))
    return g.select(*by, "n", "n_a", "n_b", chi2.alias("chi2"), v.alias("cramers_v"))


@F.pandas_udf(DoubleType())
def _expected_term(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """Expected k/N ln(kN/(ab)) for the overlap k of an a-set and a b-set among N items. The overlap
    law is built outward from its mode by ratios and normalised, so no factorials are needed. Beyond
    sqrt(373 min(a,b)) from the mean a weight is below the smallest double."""
    import numpy as np

    out = np.empty(len(a))
    for i, (ai, bi, ni) in enumerate(zip(a, b, n)):
        small = min(ai, bi)
        mid, reach = ai * bi / ni, (373.0 * small) ** 0.5 + 2
        lo = int(max(ai + bi - ni, 0, mid - reach))
        hi = int(min(small, mid + reach))
        k = np.arange(lo, hi + 1, dtype=np.float64)
        step = np.log(ai - k[:-1]) + np.log(bi - k[:-1]) - np.log(k[:-1] + 1) - np.log(ni - ai - bi + k[:-1] + 1)
        logw = np.concatenate([[0.0], np.cumsum(step)])
        w = np.exp(logw - logw.max())
        pos = k > 0
        kp = k[pos]
        out[i] = float((w[pos] * kp / ni * np.log(kp * ni / ai / bi)).sum() / w.sum())
    import pandas as pd

    return pd.Series(out)


def expected_mi(ct: DataFrame, a: str, b: str) -> DataFrame:
    """Expected mutual information under fixed margins. A term depends on the two margin values only,
    so equal values are merged first: a labeling of N rows has fewer than sqrt(2N) distinct sizes."""
    total = ct.agg(F.sum("n")).scalar()
    rows = ct.groupBy(a).agg(F.sum("n").alias("_a")).groupBy("_a").agg(F.count(F.lit(1)).alias("_ma"))
    cols = ct.groupBy(b).agg(F.sum("n").alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_mb"))
    packed = cols.agg(F.collect_list(F.struct("_b", "_mb"))).scalar()
    grid = rows.select("_a", "_ma", F.inline(packed)).repartition("_a", "_b")
    term = _expected_term(F.col("_a"), F.col("_b"), total)
    return grid.where((F.col("_a") > 0) & (F.col("_b") > 0)).agg(F.sum(term * F.col("_ma") * F.col("_mb")).alias("emi"))


def adjusted_mi(ct: DataFrame, a: str, b: str) -> DataFrame:
    """AMI with the arithmetic-mean normaliser, one row (mi, emi, ami)."""
    m = measures(ct, a, b)
    out = m.select("mi", "h_a", "h_b", "n_a", "n_b", expected_mi(ct, a, b).scalar().alias("emi"))
    room = (F.col("h_a") + F.col("h_b")) / 2.0 - F.col("emi")
    tiny = F.lit(2.220446049250313e-16)
    room = F.when(room < 0, F.least(room, -tiny)).otherwise(F.greatest(room, tiny))
    one = (F.col("n_a") <= 1) & (F.col("n_b") <= 1)
    return out.select("mi", "emi", F.when(one, 1.0).otherwise((F.col("mi") - F.col("emi")) / room).alias("ami"))


def entropy(counts: DataFrame, n: str = "n", by: Sequence[str] = (), normaliser: str = "observed", size: int | None = None) -> DataFrame:
    """Entropy, its normalised form and exp(entropy) per group. normaliser: `observed` divides by the
    log of the non-empty categories, `listed` by the log of all listed rows, `size` by log(size);
    one category (or a zero normaliser) gives 0."""
    x = F.col(n).cast("double")
    g = counts.groupBy(*by).agg(
        F.sum(x).alias("_n"), F.sum(_nlogn(x)).alias("_l"), F.count_if(x > 0).alias("_seen"), F.count(F.lit(1)).alias("_listed")
    )
    h = F.when(F.col("_seen") > 1, F.ln("_n") - F.col("_l") / F.col("_n")).otherwise(0.0)
    cells = {"observed": F.col("_seen"), "listed": F.col("_listed"), "size": F.lit(size)}[normaliser]
    scaled = F.when((F.col("_seen") > 1) & (cells > 1), h / F.ln(cells.cast("double"))).otherwise(0.0)
    return g.select(*by, h.alias("entropy"), scaled.alias("normalized_entropy"), F.exp(h).alias("effective_number"))


def concentration(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Per cluster b: total, categories present, inverse-Simpson and exp-entropy effective numbers,
    largest, top-3 and top-5 share, dominant category (smallest on ties). The rank limit is applied
    before the shuffle, so a cluster with millions of categories sends five rows per task."""
    key = [*by, b]
    x = F.col("n").cast("double")
    g = ct.where(F.col("n") > 0).groupBy(*key).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("categories"), F.sum(x * x).alias("_sq"), F.sum(_nlogn(x)).alias("_l")
    )
    w = Window.partitionBy(*key).orderBy(F.desc("n"), F.asc(a))
    top = ct.where(F.col("n") > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5)
    t = top.groupBy(*key).agg(
        F.sum(F.when(F.col("_r") <= 3, F.col("n"))).alias("_top3"), F.sum("n").alias("_top5"),
        F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("_top1"), F.max(F.when(F.col("_r") == 1, F.col(a))).alias("dominant"),
    )
    n = F.col("total").cast("double")
    h = F.when(F.col("categories") > 1, F.ln(n) - F.col("_l") / n).otherwise(0.0)
    return g.join(t, key).select(
        *key, "total", "categories", (n * n / F.col("_sq")).alias("inverse_simpson"), F.exp(h).alias("effective_number"),
        h.alias("entropy"), (F.col("_top1") / n).alias("max_share"), (F.col("_top3") / n).alias("top3_share"),
        (F.col("_top5") / n).alias("top5_share"), "dominant",
    )


def category_profiles(df: DataFrame, category: str, cluster: str, k: int) -> DataFrame:
    """Per category: count, normalised entropy over k clusters, dominant cluster (first on ties) and
    its share. One aggregate; the k counts stay in one array."""
    g = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col(cluster) == j) for j in range(k)]).alias("counts")
    )
    share = lambda c: c / F.col("n")
    h = -F.aggregate("counts", F.lit(0.0), lambda s, c: s + plogp(share(c)))
    top = F.array_max("counts")
    return g.select(
        category, "n", (h / F.lit(float(np.log(k))) if k > 1 else F.lit(0.0)).alias("normalized_entropy"),
        (F.array_position("counts", top) - 1).cast("bigint").alias("dominant_cluster"), share(top).alias("dominant_share"),
        "counts",
    )


def category_summary(profiles: DataFrame) -> DataFrame:
    """Mean, std, min, max of the entropy, of the dominant share, and the median category size."""
    g = profiles.agg(
        F.count(F.lit(1)).alias("categories"), F.avg("normalized_entropy").alias("mean_entropy"),
        F.stddev_pop("normalized_entropy").alias("std_entropy"), F.min("normalized_entropy").alias("min_entropy"),
        F.max("normalized_entropy").alias("max_entropy"), F.avg("dominant_share").alias("mean_dominant"),
        F.max("dominant_share").alias("max_dominant"),
    )
    mid = quantiles(profiles, [], "n", {"median_n": 0.5})
    return g.withColumn("median_n", mid.scalar())


def _l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def unit_histograms(df: DataFrame, unit: str, category: str, categories: Sequence) -> DataFrame:
    """(unit, h, q, r): shares of the categories, the shares thinned by floor(10 %) of each count, and their distance."""
    g = df.groupBy(unit).agg(F.array(*[F.count_if(F.col(category) == c) for c in categories]).alias("_c"))
    norm = lambda c: F.transform(c, lambda v: v / F.greatest(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, q: s + q), F.lit(1)))
    thin = F.transform("_c", lambda v: v - F.floor(v * F.lit(0.1)))
    both = g.select(unit, norm(F.col("_c")).alias("h"), thin.alias("_t")).select(unit, "h", norm(F.col("_t")).alias("q"))
    return both.withColumn("r", _l2(F.col("q"), F.col("h")))


def rivals(first: DataFrame, unit: str, categories: int) -> DataFrame:
    """(unit, r, other, dist): for each thinned histogram the other histograms that its own distance can't exclude. Two points that lie within r differ by at most r in their
    distances from any third, so those from a few corners of the simplex are cut into cells, and a unit meets only the cells that its r reaches. Rows of `first` have different h."""
    width = first.where("r > 0").agg(F.percentile_approx("r", 0.95)).scalar()
    corners = range(min(3, categories))

    def away(v: Column, i: int) -> Column:
        # distance from the corner at which category i has all
        square = F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
        return F.sqrt(F.greatest(square - 2 * v[i] + 1, F.lit(0.0)))

    ask = first.where("r > 0").withColumn("_w", width)
    for i in corners:
        lo, hi = (F.floor((away(F.col("q"), i) + s * (F.col("r") + 1e-9)) / F.col("_w")) for s in (-1, 1))
        ask = ask.withColumn(f"_p{i}", F.explode(F.sequence(lo, hi)))
    at = first.withColumn("_w", width)
    at = at.select(F.col(unit).alias("other"), F.col("h").alias("_h"), *[F.floor(away(F.col("h"), i) / F.col("_w")).alias(f"_p{i}") for i in corners])
    met = ask.join(at, [f"_p{i}" for i in corners]).where(F.col("other") != F.col(unit))
    return met.select(unit, "r", "other", _l2(F.col("q"), F.col("_h")).alias("dist"))


def self_consistency(df: DataFrame, unit: str, category: str, categories: Sequence) -> DataFrame:
    """Share of units whose histogram, thinned by floor(10 %) of each count, lies nearest (L2) to the unit's own full histogram among all units; smallest unit on ties. Units with equal
    histograms are one point, of which only the smallest unit can be found; a unit at distance 0 needs no search."""
    both = unit_histograms(df, unit, category, categories)
    first = both.groupBy("h").agg(F.min_by(F.struct(unit, "q", "r"), unit).alias("_f")).select("h", "_f.*")
    closer = (F.col("dist") < F.col("r")) | ((F.col("dist") == F.col("r")) & (F.col("other") < F.col(unit)))
    beaten = rivals(first, unit, len(categories)).where(closer).select(unit).distinct()
    found = first.agg(F.count("*")).scalar() - beaten.agg(F.count("*")).scalar()
    n = F.count("*")
    return both.agg(n.alias("units"), (found / n).alias("accuracy"), (1.0 / n).alias("chance"))


def within(ct: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Labeling b inside each class of a: cells with their share of the class, its exp-entropy
    effective number and the share of its largest b."""
    key = [*by, a]
    x = F.col("n").cast("double")
    g = ct.groupBy(*key).agg(F.sum("n").alias("n_a"), F.sum(_nlogn(x)).alias("_l"), F.max("n").alias("_top"))
    n = F.col("n_a").cast("double")
    h = F.ln(n) - F.col("_l") / n
    stats = g.select(*key, "n_a", F.exp(h).alias("effective_number"), (F.col("_top") / n).alias("dominant_share"))
    return join_nullsafe(ct, stats, key).select(*key, b, "n", (F.col("n") / F.col("n_a")).alias("fraction"), "n_a", "effective_number", "dominant_share")


def within_map(ct: DataFrame, a: str, b: str) -> DataFrame:
    """The shares as one map column per class of a, for tables with a bounded number of clusters b."""
    w = within(ct, a, b)
    entries = F.sort_array(F.collect_list(F.struct(F.col(b).cast("string"), F.col("fraction"))))
    return w.groupBy(a).agg(F.map_from_entries(entries).alias("fractions"))


# ---- label alignment ---------------------------------------------------------------------------

def align(ct: DataFrame, reference: str, candidate: str, k: int, by: Sequence[str]) -> DataFrame:
    """Mapping candidate -> reference label of maximum overlap per group: (by, candidate, aligned). The
    counting is distributed; a group is at most k x k cells. Candidates beyond the reference labels
    get fresh ids from k upward."""
    kinds = dict(ct.dtypes)

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        top = max(k, int(cells[candidate].max()) + 1)
        overlap = np.zeros((top, top), dtype=np.int64)
        overlap[cells[reference].astype(int), cells[candidate].astype(int)] = cells["n"]
        match = best_assignment(overlap)
        out = pd.DataFrame({candidate: match, "aligned": range(top)})
        for c in by:
            out[c] = cells[c].iloc[0]
        return out[[*by, candidate, "aligned"]]

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"{candidate} long", "aligned long"])
    grouped = ct.groupBy(*by) if by else ct.withColumn("_all", F.lit(0)).groupBy("_all")
    return grouped.applyInPandas(solve, schema)


def align_seeds(labels: DataFrame, key: str, seed: str, cluster: str, k: int, seeds: Sequence[int], reference: int) -> DataFrame:
    """Mapping of every seed's clusters to those of the reference seed."""
    wide = by_seed(labels, key, seed, cluster, seeds)
    ref = F.element_at("_s", list(seeds).index(reference) + 1)
    long = wide.select(ref.alias("_ref"), F.posexplode("_s").alias("_i", cluster))
    long = long.select(F.element_at(F.array(*[F.lit(s).cast("bigint") for s in seeds]), F.col("_i") + 1).alias(seed), "_ref", cluster)
    ct = contingency(long.where(F.col(cluster).isNotNull() & F.col("_ref").isNotNull()), "_ref", cluster, [seed])
    return align(ct, "_ref", cluster, k, [seed])


def apply_mapping(labels: DataFrame, mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds `aligned`; a label without a mapping keeps NULL there and `unmapped` is true. The mapping
    has one row per seed and cluster."""
    out = labels.join(F.broadcast(mapping), list(on), "left")
    return out.withColumn("unmapped", F.col("aligned").isNull())


# ---- several labelings -------------------------------------------------------------------------

def by_seed(labels: DataFrame, key: str, seed: str, cluster: str, seeds: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key with the labels of all seeds as an array `_s` in the given order."""
    picks = [F.max(F.when(F.col(seed) == s, F.col(cluster))) for s in seeds]
    return labels.groupBy(key, *carry).agg(F.array(*picks).alias("_s"))


def seed_pairs(wide: DataFrame, seeds: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """(carry, seed_a, seed_b, label_a, label_b) for every pair of seeds, by a projection of the row."""
    cells = [
        F.struct(
            F.lit(a).cast("bigint").alias("seed_a"), F.lit(b).cast("bigint").alias("seed_b"),
            F.col("_s")[i].alias("label_a"), F.col("_s")[j].alias("label_b"),
        )
        for i, a in enumerate(seeds) for j, b in enumerate(seeds) if i < j
    ]
    out = wide.select(*carry, F.inline(F.array(*cells)))
    return out.where(F.col("label_a").isNotNull() & F.col("label_b").isNotNull())


def pairwise_agreement(wide: DataFrame, seeds: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """ARI, NMI and raw agreement of every pair of seeds (by `carry`)."""
    by = [*carry, "seed_a", "seed_b"]
    ct = contingency(seed_pairs(wide, seeds, carry), "label_a", "label_b", by)
    same = ct.groupBy(*by).agg(
        (F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement")
    )
    return measures(ct, "label_a", "label_b", by).select(*by, "n", "ari", "nmi").join(same, by)


def summarize_pairs(pairs_df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, std, min, max, median and IQR of pair metrics: (by, metric, ...). Pairs are few."""
    long = pairs_df.unpivot([F.col(c) for c in by] or [], [F.col(m) for m in metrics], "metric", "value") if by else pairs_df.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    )
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        q[1].alias("median"), (q[2] - q[0]).alias("iqr"),
    )


def js_similarity(counts: DataFrame, seed: str, category: str, seeds: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """1 - sqrt(Jensen-Shannon divergence, base 2) of the category distributions of every pair of
    seeds within `by`; input rows (by, seed, category, n). Pairs with an empty side are left out."""
    picks = [F.coalesce(F.sum(F.when(F.col(seed) == s, F.col("n"))), F.lit(0)).cast("double") for s in seeds]
    wide = counts.groupBy(*by, category).agg(F.array(*picks).alias("_v"))
    totals = [F.coalesce(F.sum(F.when(F.col(seed) == s, F.col("n"))), F.lit(0)).cast("double") for s in seeds]
    tot = counts.groupBy(*by).agg(F.array(*totals).alias("_t"))
    both = wide.join(tot, list(by)) if by else wide.withColumn("_t", tot.scalar())
    cells = []
    for i, a in enumerate(seeds):
        for j, b in enumerate(seeds):
            if i < j:
                p = F.col("_v")[i] / F.nullif(F.col("_t")[i], F.lit(0.0))
                q = F.col("_v")[j] / F.nullif(F.col("_t")[j], F.lit(0.0))
                cells.append(F.struct(F.lit(a).cast("bigint").alias("seed_a"), F.lit(b).cast("bigint").alias("seed_b"), p.alias("p"), q.alias("q")))
    long = both.select(*by, F.inline(F.array(*cells))).where(F.col("p").isNotNull() & F.col("q").isNotNull())
    mid = (F.col("p") + F.col("q")) / 2.0
    half = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    out = long.groupBy(*by, "seed_a", "seed_b").agg(F.sum((half(F.col("p")) + half(F.col("q"))) / 2.0).alias("_d"))
    return out.select(*by, "seed_a", "seed_b", (1.0 - F.sqrt(clip01(F.col("_d")))).alias("js_similarity"))


def unit_occupancy(labels: DataFrame, unit: str, cluster: str, k: int) -> DataFrame:
    """Per cluster over ALL units (zeros included): units that show it, median, quartiles, min, max of
    the per-unit share."""
    grid = cluster_counts(labels, k, cluster, [unit])
    g = grid.groupBy(cluster).agg(
        F.count_if(F.col("n") > 0).alias("units_with"), F.min("fraction").alias("min"), F.max("fraction").alias("max")
    )
    q = quantiles(grid, [cluster], "fraction", {"q25": 0.25, "median": 0.5, "q75": 0.75}, few_keys=True)
    return g.join(q, cluster)


def contributors(labels: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column (fish, context) per cluster."""
    return labels.groupBy(cluster).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])
