"""Bindings of scaling, reduction, clustering, sampling, bootstrap, embeddings, probes and plans."""

from pyspark.sql import functions as F

from boutwise.operators import agreement as G
from boutwise.operators import bootstrap as BS
from boutwise.operators import clustering as C
from boutwise.operators import decisions as D
from boutwise.operators import embedding as E
from boutwise.operators import features as FE
from boutwise.operators import linear as L
from boutwise.operators import probes as P
from boutwise.operators import quality as Q
from boutwise.operators import sampling as S
from boutwise.operators import scaling as N
from boutwise.plans import evaluation as V
from boutwise.plans import selection as SEL

from .agreement import PAIRG, wide_labels
from .base import (
    BOUTS, CORE, EMB, FISH, K, LAB, SAMPLES, SEEDS, bouts, embeddings, fish, labelings, query, rounded, samples, seed_centres, split, table,
)
from .effects import FLAB, seed_profiles
from .features import IDS, SETB

# ---- scaling -----------------------------------------------------------------------------------

SCALED = [f for f in FE.CORE_FEATURES if f != "turn_net_rad"]


def features_with_partition(spark, d):
    return S.inherit_partition(FE.core_features(bouts(spark, d)).drop("start", "end", "stimulus"), split(spark, d))


def flagship(spark, d):
    """Events to bouts to 18 features to training-only z-scores of every partition."""
    f = features_with_partition(spark, d)
    p = N.fit_scaler(f.where(F.col("partition") == "train"), FE.CORE_FEATURES)
    return N.apply_scaler(f, FE.CORE_FEATURES, p)


FSPLIT = f"WITH {CORE}, {FISH.strip()}, fp AS (SELECT c.*, s.partition FROM core c JOIN split s USING (fish_id)), tr AS (SELECT * FROM fp WHERE partition='train')"
MEANS = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in SCALED)


@query("nrm_1_train_zscore", f"{FSPLIT}, p AS (SELECT {MEANS} FROM tr) SELECT fish_id, bout_index, partition, {', '.join(f'round(({f}-m_{f})/CASE WHEN s_{f}=0 THEN 1 ELSE s_{f} END,6) AS {f}' for f in SCALED)} FROM fp, p")
def _(spark, d):
    return rounded(flagship(spark, d).drop("turn_net_rad"))


@query("nrm_1_scaler_parameters", f"{FSPLIT}, p AS (SELECT {MEANS} FROM tr) SELECT unnest([{', '.join(repr(f) for f in SCALED)}]) AS feature, round(unnest([{', '.join('m_' + f for f in SCALED)}]),6) AS mean, round(unnest([{', '.join('s_' + f for f in SCALED)}]),6) AS scale FROM p")
def _(spark, d):
    f = features_with_partition(spark, d)
    return rounded(N.fit_scaler(f.where(F.col("partition") == "train"), SCALED))


@query("val_5_scaling_audit", f"{FSPLIT} SELECT unnest([{', '.join(repr(f) for f in SCALED)}]) AS feature, true AS passed")
def _(spark, d):
    a = Q.scaling_audit(flagship(spark, d), SCALED)
    return a.select("feature", "passed")


@query("val_5_metadata_difference", "SELECT CASE WHEN doc_id%2=0 THEN 'left' ELSE 'right' END AS side, doc_id, lang FROM documents WHERE doc_id%100 IN (4, 7)")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    return Q.metadata_difference(t.where(F.col("doc_id") % 100 != 7), t.where(F.col("doc_id") % 100 != 4), ["doc_id", "lang"]).select("side", "doc_id", "lang")


B3 = ["inter_bout_interval", "speed_mean", "speed_change_rms"]


@query("nrm_3_impute_zscore", f"""WITH {BOUTS}, {FISH.strip()}, v AS (SELECT fish_id, bout_index, avg(speed) AS speed_mean, sqrt(avg(ds*ds)) AS speed_change_rms FROM steps GROUP BY ALL),
i AS (SELECT fish_id, bout_index, ("start"-lag("end") OVER (PARTITION BY fish_id ORDER BY bout_index))/160.0 AS inter_bout_interval FROM bouts),
f AS (SELECT v.*, i.inter_bout_interval, s.partition FROM v JOIN i USING (fish_id, bout_index) JOIN split s USING (fish_id)),
md AS (SELECT {', '.join(f'median({c}) AS d_{c}' for c in B3)} FROM f WHERE partition='train'), g AS (SELECT fish_id, bout_index, partition, {', '.join(f'coalesce({c}, d_{c}) AS {c}' for c in B3)} FROM f, md),
p AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in B3)} FROM g WHERE partition='train')
SELECT fish_id, bout_index, {', '.join(f'round(({c}-m_{c})/s_{c},6) AS {c}' for c in B3)} FROM g, p""")
def _(spark, d):
    f = S.inherit_partition(FE.variable_features(bouts(spark, d)).select(*IDS, *B3), split(spark, d))
    train = F.col("partition") == "train"
    g = N.impute(f, B3, N.fit_medians(f.where(train), B3))
    return rounded(N.apply_scaler(g, B3, N.fit_scaler(g.where(train), B3, zero_is_error=True)).drop("partition"))


@query("nrm_4_sample_stats", f"WITH {SAMPLES}, {FISH.strip()} SELECT count(*) AS n, round(avg(speed),6) AS mean, round(stddev_pop(speed),6) AS std FROM samples JOIN split USING (fish_id) WHERE partition='train'")
def _(spark, d):
    b = S.inherit_partition(bouts(spark, d), split(spark, d)).where(F.col("partition") == "train")
    return rounded(N.fit_array_stats(b))


@query("nrm_5_normalised_channel", f"""WITH {SAMPLES}, {FISH.strip()}, p AS (SELECT avg(speed) AS m, stddev_pop(speed) AS s FROM samples JOIN split USING (fish_id) WHERE partition='train')
SELECT fish_id, bout_index, pos, round((speed-m)/s,6) AS speed FROM samples, p""")
def _(spark, d):
    b = bouts(spark, d)
    t = S.inherit_partition(b, split(spark, d)).where(F.col("partition") == "train")
    z = N.apply_array_stats(b, N.fit_array_stats(t))
    return rounded(z.select(*IDS, F.posexplode("speed").alias("pos", "speed")))


@query("nrm_6_profile_zscore", f"WITH {FLAB}, m AS (SELECT seed, feature, cluster, avg(v) AS x FROM f GROUP BY ALL) SELECT seed, feature, cluster, round((x-avg(x) OVER w)/CASE WHEN stddev_pop(x) OVER w>0 THEN stddev_pop(x) OVER w ELSE 1 END,6) AS z FROM m WINDOW w AS (PARTITION BY seed, feature)")
def _(spark, d):
    from boutwise.operators import effects as X

    from .effects import FEATS, featured

    m = X.group_moments(featured(spark, d), "cluster", FEATS, ["seed"])
    return rounded(N.zscore_within(m, "mean", ["seed", "feature"]).select("seed", "feature", "cluster", "z"))


# ---- reduction ---------------------------------------------------------------------------------


def train_rows(spark, d):
    return embeddings(spark, d).where(F.col("partition") == "train")


@query("pca_1_variance_target", None)
def _(spark, d):
    e = embeddings(spark, d)
    m = L.fit_pca(e.where(F.col("partition") == "train"), "embedding", 0.95)
    return rounded(m.project(e, "embedding").select("vec_id", F.posexplode("pc").alias("component", "value")))


@query("pca_2_fixed_components", None)
def _(spark, d):
    e = embeddings(spark, d)
    m = L.fit_pca(e.where(F.col("partition") == "train"), "embedding", k=6)
    return rounded(m.project(e, "embedding").select("vec_id", F.posexplode("pc").alias("component", "value")))


@query("pca_3_diagnostics", None)
def _(spark, d):
    return rounded(E.pca_report(spark, train_rows(spark, d), "embedding"))


@query("pca_4_first_component_correlation", None)
def _(spark, d):
    e = embeddings(spark, d)
    p = L.fit_pca(e, "embedding", k=1).project(e, "embedding").select(F.col("pc")[0].alias("pc1"), F.col("embedding")[0].cast("double").alias("nuisance"))
    r = p.agg(F.corr("pc1", "nuisance").alias("r"))
    return rounded(r.select(F.abs("r").alias("abs_r"), (F.col("r") * F.col("r")).alias("explained")))


# what SQL can tell of a decomposition: rows, trace and sum of squares of the covariance, lengths of fully rotated rows; the rest are identities the operator checks on itself
PCOV = f"""{EMB}, el AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(e) AS x FROM emb WHERE partition='train'), m AS (SELECT dim, avg(x) AS m FROM el GROUP BY dim),
cov AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS c FROM el a JOIN el b USING (vec_id) GROUP BY a.dim, b.dim)"""


@query("pca_1_decomposition_checks", f"""WITH {PCOV} SELECT (SELECT count(*) FROM emb WHERE partition='train') AS n, 64::BIGINT AS axes, round(sum(CASE WHEN i=j THEN c END),6) AS trace, round(sum(c*c),6) AS squares,
true AS descending, true AS orthonormal, true AS are_eigenvectors, true AS target_reached FROM cov""")
def _(spark, d):
    tr = train_rows(spark, d)
    m = L.principal_axes(tr, "embedding")
    w, off, k = m.scatter / m.n, L.axis_checks(tr, "embedding", m), m.needed(0.95)
    total = [float(m.ratios[: k - 1].sum()), float(m.ratios[:k].sum())]
    row = (m.n, len(w), float(w.sum()), float((w * w).sum()), bool((w[1:] <= w[:-1]).all()), off["orthonormality"] < 1e-9, off["residual"] < 1e-9, total[0] < 0.95 <= total[1] + 1e-12)
    return rounded(spark.createDataFrame([row], "n long, axes long, trace double, squares double, descending boolean, orthonormal boolean, are_eigenvectors boolean, target_reached boolean"))


@query("pca_2_full_rotation", f"WITH {PCOV} SELECT vec_id, round(sum((x-m)*(x-m)),6) AS length FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest(e) AS x FROM emb) JOIN m USING (dim) GROUP BY vec_id")
def _(spark, d):
    e = embeddings(spark, d)
    pc = L.fit_pca(e.where(F.col("partition") == "train"), "embedding", k=64).project(e, "embedding")
    return rounded(pc.select("vec_id", F.aggregate("pc", F.lit(0.0), lambda t, x: t + x * x).alias("length")))


# ---- clustering --------------------------------------------------------------------------------


def lloyd_sql(rows, start, steps):
    """SQL of `steps` Lloyd iterations from start(cluster, c) over rows(id, e)."""
    out = f"c0 AS ({start})"
    for i in range(steps):
        out += f""", a{i} AS (SELECT id, e, cluster FROM {rows}, c{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(e, c), cluster)=1),
c{i + 1} AS (SELECT cluster, list(m ORDER BY j) AS c FROM (SELECT cluster, j, avg(x) AS m FROM (SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster)"""
    return out


@query("clu_1_lloyd", f"""WITH {LAB}, r AS (SELECT vec_id AS id, e FROM emb WHERE partition='train'), {lloyd_sql('r', 'SELECT cluster, c FROM centres WHERE seed=11', 3)}
SELECT cluster, unnest(range(64)) AS dim, round(unnest(c),6) AS value FROM c3""")
def _(spark, d):
    m = C.lloyd(train_rows(spark, d), "embedding", seed_centres(spark, d)[11], 3)
    return rounded(C.frozen_table(spark, m).select("cluster", F.posexplode("centre").alias("dim", "value")))


@query("clu_1_kmeans_restarts", None)
def _(spark, d):
    e = embeddings(spark, d)
    m = C.fit_kmeans(e.where(F.col("partition") == "train"), "embedding", 4, 20260822, key="vec_id")
    lab = C.assign(e, "embedding", m, ["vec_id", "partition"])
    return C.cluster_counts(lab, 4, by=["partition"])


def mixture(spark, d):
    e = embeddings(spark, d)
    tr = e.where(F.col("partition") == "train")
    pca = L.fit_pca(tr, "embedding", k=4)
    mix = C.fit_gmm(pca.project(tr, "embedding").select("pc"), "pc", 2, 20260822, max_iter=30)
    return mix, pca.project(e, "embedding")


@query("clu_2_gaussian_mixture", None)
def _(spark, d):
    mix, rows = mixture(spark, d)
    held = C.predict_gmm(rows.where(F.col("partition") == "validation"), "pc", mix, ["vec_id"])
    return rounded(held.agg(F.lit(mix.bic).alias("bic"), F.lit(mix.aic).alias("aic"), F.avg("log_lik").alias("mean_log_lik"), F.count(F.lit(1)).alias("n")))


@query("clu_3_nearest_centre", f"WITH {LAB} SELECT vec_id, seed, cluster FROM lab")
def _(spark, d):
    return labelings(spark, d).select("vec_id", "seed", "cluster")


@query("clu_4_margin", f"""WITH {LAB}, two AS (SELECT vec_id, seed, dist, lead(dist) OVER (PARTITION BY vec_id, seed ORDER BY dist, cluster) AS d2, row_number() OVER (PARTITION BY vec_id, seed ORDER BY dist, cluster) AS rn FROM distances)
SELECT seed, round(avg((d2-dist)/greatest(d2,1e-12)),6) AS margin FROM two WHERE rn=1 GROUP BY seed""")
def _(spark, d):
    lab = C.assign_many(embeddings(spark, d), "embedding", seed_centres(spark, d), ["vec_id"], margins=True)
    return rounded(lab.groupBy("seed").agg(C.margin().alias("margin")))


@query("clu_5_mixture_confidence", None)
def _(spark, d):
    mix, rows = mixture(spark, d)
    return rounded(C.predict_gmm(rows, "pc", mix, ["partition"]).groupBy("partition").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")))


@query("clu_6_silhouette", f"""WITH {LAB}, x AS (SELECT vec_id, cluster FROM lab WHERE seed=11), p AS (SELECT a.vec_id, xa.cluster AS own, xb.cluster AS other, list_distance(a.e, b.e) AS dist FROM emb a JOIN x xa ON xa.vec_id=a.vec_id JOIN emb b ON b.vec_id<>a.vec_id JOIN x xb ON xb.vec_id=b.vec_id),
m AS (SELECT vec_id, own, other, avg(dist) AS d FROM p GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN own=other THEN d END) AS a, min(CASE WHEN own<>other THEN d END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END),6) AS silhouette, count(*) AS n FROM s""")
def _(spark, d):
    lab = C.assign(embeddings(spark, d), "embedding", seed_centres(spark, d)[11], ["vec_id", "embedding"])
    return rounded(C.silhouette(lab, "vec_id", "embedding", "cluster"))


@query("clu_7_occupancy", f"""WITH {LAB}, g AS (SELECT * FROM (SELECT DISTINCT seed FROM lab) CROSS JOIN (SELECT unnest(range(10)) AS cluster)), c AS (SELECT seed, cluster, count(*) AS n FROM lab WHERE partition='validation' GROUP BY ALL), t AS (SELECT seed, sum(n) AS s FROM c GROUP BY seed)
SELECT seed, round(min(coalesce(n,0)/s),6) AS min_cluster_fraction, count_if(n IS NULL)::BIGINT AS empty_clusters FROM g LEFT JOIN c USING (seed, cluster) JOIN t USING (seed) GROUP BY seed""")
def _(spark, d):
    return rounded(C.occupancy(labelings(spark, d).where(F.col("partition") == "validation"), 10, by=["seed"]))


@query("clu_8_fit_stability", None)
def _(spark, d):
    return rounded(SEL.fit_stability(train_rows(spark, d), "vec_id", "embedding", "kmeans", 3, 20260822, 3, None))


@query("clu_9_seed_stability", f"WITH {PAIRG} SELECT round(avg(ari),6) AS ari_mean, round(stddev_pop(ari),6) AS ari_std FROM meas")
def _(spark, d):
    return rounded(C.seed_summary(G.pairwise_agreement(wide_labels(spark, d), SEEDS)))


CAND = """cand AS (SELECT CASE WHEN o_custkey%2=0 THEN 'kmeans' ELSE 'gmm' END AS method, 2+o_custkey%5 AS k, o_orderkey%5 AS seed, avg(o_totalprice)/1e6 AS silhouette, stddev_pop(o_totalprice)/5e5 AS stability, min(o_totalprice)/1e6 AS frac, count_if(o_orderstatus='P')%2 AS empty FROM orders GROUP BY ALL),
scored AS (SELECT *, 0.6::DOUBLE*silhouette+0.3::DOUBLE*stability+0.1::DOUBLE*least(frac/0.05::DOUBLE,1)-CASE WHEN empty>0 THEN 1 ELSE 0 END AS score FROM cand)"""
AGGC = ", ".join(f"round({f}({m}),6) AS {m}_{n}" for m in ("score", "silhouette", "stability") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max")))


def scored(spark, d):
    o = table(spark, d, "orders")
    c = o.groupBy(
        F.when(F.col("o_custkey") % 2 == 0, "kmeans").otherwise("gmm").alias("method"), (2 + F.col("o_custkey") % 5).alias("k"), (F.col("o_orderkey") % 5).alias("seed")
    ).agg(
        (F.avg("o_totalprice") / 1e6).alias("silhouette"), (F.stddev_pop("o_totalprice") / 5e5).alias("stability"), (F.min("o_totalprice") / 1e6).alias("frac"),
        (F.count_if(F.col("o_orderstatus") == "P") % 2).alias("empty"),
    )
    return c.withColumn("score", C.selection_score(F.col("silhouette"), F.col("stability"), F.col("frac"), F.col("empty")))


@query("clu_10_selection_score", f"WITH {CAND} SELECT method, k, seed, round(score,6) AS score FROM scored")
def _(spark, d):
    return rounded(scored(spark, d).select("method", "k", "seed", "score"))


@query("clu_11_aggregate_candidates", f"WITH {CAND} SELECT method, k, count(*) AS n_fits, {AGGC} FROM scored GROUP BY ALL")
def _(spark, d):
    return rounded(C.aggregate_candidates(scored(spark, d), ["score", "silhouette", "stability"]))


@query("clu_12_select_best", f"WITH {CAND} SELECT method, k, seed, round(score,6) AS score FROM scored ORDER BY scored.score DESC, silhouette DESC, stability DESC, k, method='gmm' LIMIT 1")
def _(spark, d):
    return rounded(C.select_best(scored(spark, d)).select("method", "k", "seed", "score"))


SWEEP = {"methods": ["kmeans", "gmm"], "ks": list(range(2, 13)), "seeds": SEEDS}


@query("clu_13_selection_sweep", None)
def _(spark, d):
    e = embeddings(spark, d)
    return rounded(SEL.sweep(spark, e.where(F.col("partition") == "train"), e.where(F.col("partition") == "validation"), "vec_id", "embedding", **SWEEP))


# what SQL can tell of the candidates: their number, that every row is in a cluster of each, that every centre is the mean of its rows
@query("clu_13_candidate_checks", f"""WITH {EMB}, g AS (SELECT unnest(['kmeans', 'gmm']) AS method, k, seed FROM (SELECT unnest(range(2, 13)) AS k) CROSS JOIN (SELECT unnest({SEEDS}) AS seed))
SELECT method, k, seed, (SELECT count(*) FROM emb WHERE partition='train') AS n_train, (SELECT count(*) FROM emb WHERE partition='validation') AS n_held, true AS centres_are_means, true AS in_range FROM g""")
def _(spark, d):
    e = embeddings(spark, d)
    a, b = SEL.projected(e.where(F.col("partition") == "train"), e.where(F.col("partition") == "validation"), "vec_id", "embedding")
    c = SEL.candidates(a, b, "vec_id", "pc", **SWEEP)
    fine = F.col("silhouette").between(-1, 1) & F.col("stability").between(-1, 1.0000001) & F.col("min_cluster_fraction").between(0, 1) & F.col("empty_clusters").between(0, F.col("k") - 1)
    return c.select("method", "k", "seed", "n_train", "n_held", (F.col("centre_gap") < 1e-3).alias("centres_are_means"), fine.alias("in_range"))


@query("clu_14_refit_selected", None)
def _(spark, d):
    e = embeddings(spark, d).select("vec_id", "embedding", "partition")
    p = lambda n: e.where(F.col("partition") == n).drop("partition")
    return rounded(SEL.refit(p("train"), p("validation"), p("test"), "vec_id", "embedding", "kmeans", 4, 20260822))


@query("clu_15_speed_only", f"""WITH r AS (SELECT o_orderkey AS id, [o_totalprice/1000.0::DOUBLE] AS e FROM orders), s AS (SELECT row_number() OVER (ORDER BY md5('5:'||id), id)-1 AS cluster, e AS c FROM r QUALIFY row_number() OVER (ORDER BY md5('5:'||id), id)<=3),
{lloyd_sql('r', 'SELECT cluster, c FROM s', 3)}, f AS (SELECT id, e[1] AS v, cluster FROM r, c3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(e, c), cluster)=1)
SELECT cluster, count(*) AS n, round(avg(v),6) AS mean FROM f GROUP BY cluster""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", L.vector_of(["o_totalprice"]).alias("p")).withColumn("p", F.transform("p", lambda x: x / 1000.0))
    m = C.lloyd(o, "p", C.hashed_centres(o, "o_orderkey", "p", 3, 5), 3)
    lab = C.assign(o, "p", m, ["p"])
    return rounded(lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p")[0]).alias("mean")))


# ---- sampling ----------------------------------------------------------------------------------


@query("mld_1_subsample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:'||doc_id), doc_id LIMIT 300")
def _(spark, d):
    return S.subsample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 300, 7)


@query("mld_1_subsample_per_class", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:'||doc_id), doc_id)<=40")
def _(spark, d):
    return S.subsample_per_class(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 40, 7)


@query("mld_2_unit_split", f"WITH {FISH} SELECT * FROM split")
def _(spark, d):
    return split(spark, d)


@query("mld_3_class_holdout", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:'||doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, rn > least(greatest(1,floor(n*0.8::DOUBLE)),n-1) AS held_out FROM r WHERE n>=4""")
def _(spark, d):
    return S.class_holdout(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 3)


@query("mld_4_inherited_partition", f"WITH {BOUTS}, {FISH.strip()} SELECT b.fish_id, b.bout_index, s.partition FROM bouts b JOIN split s USING (fish_id)")
def _(spark, d):
    return S.inherit_partition(bouts(spark, d).select(*IDS), split(spark, d))


# ---- bootstrap ---------------------------------------------------------------------------------

REPS = 500
BOOT = f"""fishes AS (SELECT DISTINCT user_id AS fish_id FROM events), idx AS (SELECT fish_id, row_number() OVER (ORDER BY md5('unit:'||fish_id), fish_id)-1 AS i, count(*) OVER () AS n FROM fishes),
draws AS (SELECT rep, ('0x'||substr(md5('9:'||rep||':'||i),1,8))::BIGINT % n AS pick FROM idx, (SELECT unnest(range({REPS})) AS rep)),
wt AS (SELECT rep, fish_id, count(*) AS weight FROM draws JOIN idx ON idx.i=pick GROUP BY ALL)"""


def units(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("fish_id"), "value", "event_type")


@query("bst_1_unit_weights", f"WITH {BOOT} SELECT rep, fish_id, weight FROM wt")
def _(spark, d):
    return BS.unit_weights(units(spark, d), "fish_id", REPS, 9)


@query("bst_2_expanded_rows", f"WITH {BOOT} SELECT rep, sum(weight)::BIGINT AS rows, round(sum(weight*value),4) AS total FROM events e JOIN wt ON wt.fish_id=e.user_id GROUP BY rep")
def _(spark, d):
    u = units(spark, d)
    per = u.groupBy("fish_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    x = BS.expand(per, BS.unit_weights(u, "fish_id", REPS, 9), "fish_id")
    return x.groupBy("rep").agg(F.sum(F.col("n") * F.col("weight")).alias("rows"), F.round(F.sum(F.col("s") * F.col("weight")), 4).alias("total"))


def boot_mean(spark, d):
    pre = lambda r: r.groupBy("fish_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    stat = lambda x: x.groupBy("rep").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("value"))
    return BS.bootstrap(units(spark, d), "fish_id", pre, stat, REPS, 9)


BMEAN = f"{BOOT}, st AS (SELECT rep, sum(weight*value)/sum(weight) AS v FROM events e JOIN wt ON wt.fish_id=e.user_id GROUP BY rep)"
BQ = ", ".join(f"round(quantile_cont(v,{p}),6) AS {n}" for n, p in (("low", 0.025), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("high", 0.975)))


@query("bst_3_bootstrap_mean", f"WITH {BMEAN} SELECT round((SELECT avg(value) FROM events),6) AS point, count(*) AS replicates, {BQ} FROM st")
def _(spark, d):
    return rounded(boot_mean(spark, d))


BARI = f"""{BOOT}, cells AS (SELECT rep, event_type AS a, event_id%3 AS b, sum(weight)::DOUBLE AS n FROM events e JOIN wt ON wt.fish_id=e.user_id GROUP BY ALL),
ra AS (SELECT rep, sum(x*(x-1)/2) AS pa FROM (SELECT rep, a, sum(n) AS x FROM cells GROUP BY ALL) GROUP BY rep), rb AS (SELECT rep, sum(x*(x-1)/2) AS pb FROM (SELECT rep, b, sum(n) AS x FROM cells GROUP BY ALL) GROUP BY rep),
rc AS (SELECT rep, sum(n*(n-1)/2) AS pc, sum(n)*(sum(n)-1)/2 AS t FROM cells GROUP BY rep), st AS (SELECT rep, (pc-pa*pb/t)/((pa+pb)/2-pa*pb/t) AS v FROM ra JOIN rb USING (rep) JOIN rc USING (rep))"""


def two_labels(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("fish_id"), "event_type", (F.col("event_id") % 3).alias("third"))


@query("bst_4_bootstrap_ari", f"WITH {BARI} SELECT rep, round(v,6) AS value FROM st")
def _(spark, d):
    return rounded(BS.bootstrap_ari(two_labels(spark, d), "fish_id", "event_type", "third", REPS, 9))


@query("bst_5_interval", f"WITH {BARI} SELECT count(*) AS replicates, {BQ} FROM st")
def _(spark, d):
    return rounded(BS.interval(BS.bootstrap_ari(two_labels(spark, d), "fish_id", "event_type", "third", REPS, 9)))


# SQL recomputes each replicate's training rows by weight; fits and agreement are compared with plain loops in the tests
@query("bst_6_bootstrap_refit", f"""WITH {EMB}, tr AS (SELECT vec_id, vec_id%25 AS unit FROM emb WHERE partition='train'), idx AS (SELECT unit, row_number() OVER (ORDER BY md5('unit:'||unit), unit)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM tr)),
draws AS (SELECT rep, ('0x'||substr(md5('9:'||rep||':'||i),1,8))::BIGINT % n AS pick FROM idx, (SELECT unnest(range(500)) AS rep))
SELECT rep, count(*) AS rows, true AS in_range FROM draws JOIN idx ON idx.i=pick JOIN tr USING (unit) GROUP BY rep""")
def _(spark, d):
    e = embeddings(spark, d).withColumn("unit", F.col("vec_id") % 25)
    ref = C.hashed_centres(e, "vec_id", "embedding", 3, 11)
    r = BS.bootstrap_refit(e.where(F.col("partition") == "train"), e.where(F.col("partition") == "validation"), "unit", "vec_id", "embedding", ref, 500, 9)
    return r.select("rep", "rows", (F.col("ari").between(-1, 1.0000001) & F.col("agreement").between(1 / 3 - 1e-9, 1)).alias("in_range"))


# ---- embedding diagnostics ---------------------------------------------------------------------

DIMS = EMB + ", el AS (SELECT vec_id, partition, unnest(range(64)) AS dim, unnest(e) AS x FROM emb)"


@query("emb_1_dimension_stats", f"WITH {DIMS} SELECT partition, dim, count(*) AS n, round(avg(x),6) AS mean, round(var_pop(x),6) AS var, round(min(x),6) AS min, round(max(x),6) AS max, round(stddev_pop(x),6) AS std FROM el GROUP BY ALL")
def _(spark, d):
    return rounded(E.dimension_stats(embeddings(spark, d), "embedding", 64, ["partition"]))


@query("emb_1_partition_report", f"WITH {DIMS}, v AS (SELECT partition, dim, var_pop(x) AS v FROM el GROUP BY ALL) SELECT partition, count(*) AS dims, round(sum(v),6) AS total_variance, round(avg(v),6) AS mean_variance, round(median(v),6) AS median_variance, count_if(v<=1e-8)::BIGINT AS near_zero_dims FROM v GROUP BY partition")
def _(spark, d):
    return rounded(E.partition_report(E.dimension_stats(embeddings(spark, d), "embedding", 64, ["partition"]), by=["partition"]))


NQ = ", ".join(f"round(quantile_cont(v,{q}),6) AS {n}" for n, q in {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}.items())


@query("emb_2_norms", f"WITH {EMB}, x AS (SELECT sqrt(list_sum(list_transform(e, lambda x: x*x))) AS v FROM emb), p AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x) SELECT count(*) AS n, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max, {NQ}, count_if(v=0)::BIGINT AS zero_norms, count_if(abs(v-m)>6*s)::BIGINT AS outliers FROM x, p GROUP BY m, s")
def _(spark, d):
    return rounded(E.norm_report(embeddings(spark, d), "embedding"))


@query("emb_3_covariance", f"WITH {DIMS} SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.x, b.x),6)+0.0::DOUBLE AS cov FROM el a JOIN el b USING (vec_id) GROUP BY a.dim, b.dim")
def _(spark, d):
    return rounded(L.covariance(embeddings(spark, d), "embedding", 64))


@query("emb_3_spectrum_checks", f"WITH {DIMS}, c AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS c FROM el a JOIN el b USING (vec_id) GROUP BY a.dim, b.dim) SELECT 64::BIGINT AS rank, 64::BIGINT AS positive, round(sum(CASE WHEN i=j THEN c END),6) AS trace, round(sum(c*c),6) AS squares FROM c")
def _(spark, d):
    return rounded(E.covariance_report(spark, embeddings(spark, d), "embedding").select("rank", "positive", "trace", "squares"))


@query("emb_3_spectrum", None)
def _(spark, d):
    return rounded(E.covariance_report(spark, embeddings(spark, d), "embedding"))


@query("emb_4_partition_shift", f"""WITH {DIMS}, s AS (SELECT partition, dim, avg(x) AS m, var_pop(x) AS v FROM el GROUP BY ALL), j AS (SELECT b.m-a.m AS d, (b.m-a.m)/greatest(sqrt(a.v),1e-12) AS z, b.v/greatest(a.v,1e-12) AS r FROM s a JOIN s b USING (dim) WHERE a.partition='train' AND b.partition='validation'),
n AS (SELECT partition, sqrt(sum(x*x)) AS n FROM el GROUP BY vec_id, partition), q AS (SELECT avg(CASE WHEN partition='train' THEN n END) AS a, avg(CASE WHEN partition='validation' THEN n END) AS b, stddev_pop(CASE WHEN partition='train' THEN n END) AS s FROM n)
SELECT round(sqrt(sum(d*d)),6) AS mean_shift_l2, round(sqrt(sum(z*z)),6) AS std_shift_l2, round(avg(abs(z)),6) AS std_shift_mean, round(max(abs(z)),6) AS std_shift_max, round(avg(r),6) AS var_ratio_mean, round(median(r),6) AS var_ratio_median, round(min(r),6) AS var_ratio_min, round(max(r),6) AS var_ratio_max,
round((SELECT (b-a)/greatest(s,1e-12) FROM q),6) AS norm_shift_z FROM j""")
def _(spark, d):
    return rounded(E.partition_shift(embeddings(spark, d), "embedding", 64))


# with all components the projection keeps the distance of the scaled means
@query("emb_4_full_pca_shift", f"""WITH {DIMS}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM el WHERE partition='train' GROUP BY dim), h AS (SELECT dim, avg(x) AS m FROM el WHERE partition='validation' GROUP BY dim)
SELECT 64::BIGINT AS components, round(sqrt(sum(((h.m-s.m)/CASE WHEN s.s>0 THEN s.s ELSE 1 END)^2)),6) AS mean_shift_l2 FROM s JOIN h USING (dim)""")
def _(spark, d):
    return rounded(E.pca_shift(spark, embeddings(spark, d), "embedding", 64, variance=1.0))


@query("emb_4_pca_shift", None)
def _(spark, d):
    return rounded(E.pca_shift(spark, embeddings(spark, d), "embedding", 64))


SLICES = {11: (1, 32), 23: (33, 32), 37: (1, 64)}
GEO = f"""{EMB}, smp AS (SELECT vec_id, row_number() OVER (ORDER BY md5('5:'||vec_id), vec_id)-1 AS i, count(*) OVER () AS n FROM (SELECT vec_id FROM emb ORDER BY md5('5:'||vec_id), vec_id LIMIT 400)),
dr AS (SELECT pair, ('0x'||substr(md5('5:first:'||pair),1,8))::BIGINT % n AS a, 1+('0x'||substr(md5('5:second:'||pair),1,8))::BIGINT % (n-1) AS sh, n FROM (SELECT unnest(range(600)) AS pair), (SELECT any_value(n) AS n FROM smp)),
pr AS (SELECT pair, x.vec_id AS a, y.vec_id AS b FROM dr JOIN smp x ON x.i=dr.a JOIN smp y ON y.i=(dr.a+sh)%dr.n)"""


def geometry_pairs(spark, d):
    return E.sampled_pairs(embeddings(spark, d), "vec_id", 400, 600, 5)


@query("emb_5_sampled_pairs", f"WITH {GEO} SELECT pair, a, b FROM pr")
def _(spark, d):
    return geometry_pairs(spark, d)


@query("emb_5_geometry_similarity", f"""WITH {GEO}, ds AS (SELECT pair, s.seed, list_distance(CASE s.seed WHEN 11 THEN x.e[1:32] WHEN 23 THEN x.e[33:64] ELSE x.e END, CASE s.seed WHEN 11 THEN y.e[1:32] WHEN 23 THEN y.e[33:64] ELSE y.e END) AS d FROM pr JOIN emb x ON x.vec_id=pr.a JOIN emb y ON y.vec_id=pr.b, (SELECT unnest([11,23,37]) AS seed) s),
xy AS (SELECT p.seed::BIGINT AS seed_a, q.seed::BIGINT AS seed_b, p.d AS x, q.d AS y FROM ds p JOIN ds q ON p.pair=q.pair AND p.seed<q.seed), rk AS (SELECT *, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY x)+(count(*) OVER (PARTITION BY seed_a, seed_b, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY y)+(count(*) OVER (PARTITION BY seed_a, seed_b, y)-1)/2.0 AS ry FROM xy)
SELECT seed_a, seed_b, round(corr(rx, ry),6) AS rho, count(*) AS n FROM rk GROUP BY ALL""")
def _(spark, d):
    e = embeddings(spark, d)
    per = None
    for s, (a, n) in SLICES.items():
        one = e.select("vec_id", F.slice("embedding", a, n).alias("v"), F.lit(s).cast("bigint").alias("seed"))
        per = one if per is None else per.unionByName(one)
    dist = E.pair_distances(geometry_pairs(spark, d), per, "vec_id", "v")
    return rounded(E.geometry_similarity(dist, list(SLICES)))


@query("emb_6_frozen_encoder", None)
def _(spark, d):
    m = FE.model_input(bouts(spark, d).where(F.size("speed") >= 2), IDS, length=FE.INPUT_LENGTH)
    return E.encode(m, E.encoder_weights(11)).select(*IDS, F.size("embedding").alias("dim"), F.col("embedding")[0].alias("first"))


LOSS = f"""{EMB}, z AS (SELECT vec_id, vec_id//32 AS batch, 0 AS view, e FROM emb UNION ALL SELECT vec_id, vec_id//32, 1, list_concat(e[1:48], list_transform(range(16), lambda x: 0.0::DOUBLE)) FROM emb),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM z), s AS (SELECT a.batch, a.vec_id, a.view, b.vec_id=a.vec_id AS own, list_dot_product(a.e, b.e)/(a.nrm*b.nrm)/0.1::DOUBLE AS sim FROM u a JOIN u b ON a.batch=b.batch AND NOT (a.vec_id=b.vec_id AND a.view=b.view)),
l AS (SELECT batch, vec_id, view, ln(sum(exp(sim)))-max(CASE WHEN own THEN sim END) AS loss FROM s GROUP BY ALL)"""


def losses(spark, d):
    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = F.concat(F.slice("a", 1, 48), F.array_repeat(F.lit(0.0), 16))
    return E.contrastive_loss(e.select(E.batch_of("vec_id", 32).alias("batch"), "a", b.alias("b")), "batch", "a", "b")


@query("emb_7_contrastive_loss", f"WITH {LOSS} SELECT batch, count(*)//2 AS n, round(avg(loss),6) AS loss FROM l GROUP BY batch")
def _(spark, d):
    return rounded(losses(spark, d))


@query("emb_7_mean_loss", f"WITH {LOSS} SELECT count(*)//2 AS n, round(avg(loss),6) AS loss FROM l")
def _(spark, d):
    return rounded(E.mean_loss(losses(spark, d)))


# ---- probes ------------------------------------------------------------------------------------

COORDS = ["e1", "e2", "e3", "e4", "e5", "e6"]


def coords(spark, d):
    """Embedding coordinates as features, the nearest of three centres on them as the label."""
    e = embeddings(spark, d).select("vec_id", "label", "partition", F.slice("embedding", 1, 6).alias("v"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COORDS)])
    lab = C.assign(e, "v", C.hashed_centres(e, "vec_id", "v", 3, 11), ["vec_id", "label", "partition", *COORDS])
    return lab.withColumn("speed", F.col("e1") * 2 + F.col("e2") * F.col("e3"))


def parts(spark, d):
    c = coords(spark, d)
    return c.where(F.col("partition") == "train"), c.where(F.col("partition") == "validation")


ALL_COORDS = [f"e{i + 1}" for i in range(64)]


def all_parts(spark, d):
    """All 64 coordinates and the frozen labels of the first seed; training and validation rows."""
    e = embeddings(spark, d).select("vec_id", "partition", "embedding", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(ALL_COORDS)])
    lab = C.assign(e, "embedding", seed_centres(spark, d)[SEEDS[0]], ["vec_id", "partition", *ALL_COORDS])
    return lab.where(F.col("partition") == "train"), lab.where(F.col("partition") == "validation")


@query("prb_1_logistic_balanced", None)
def _(spark, d):
    a, b = parts(spark, d)
    return rounded(P.classification_scores(P.logistic_probe(a, b, COORDS, "cluster", max_iter=30)))


@query("prb_2_logistic", None)
def _(spark, d):
    a, b = parts(spark, d)
    return rounded(P.classification_scores(P.logistic_probe(a, b, COORDS, "cluster", balanced=False, max_iter=30, fill=True)))


@query("prb_3_boosted_trees", None)
def _(spark, d):
    a, b = all_parts(spark, d)
    return rounded(P.classification_scores(P.boosted_probe(a, b, ALL_COORDS, "cluster", key="vec_id")))


@query("prb_3_random_forest", None)
def _(spark, d):
    a, b = parts(spark, d)
    return rounded(P.classification_scores(P.forest_probe(a, b, COORDS, "cluster", trees=10)))


@query("prb_4_speed_only", None)
def _(spark, d):
    a, b = parts(spark, d)
    return rounded(P.classification_scores(P.logistic_probe(a, b, ["speed"], "cluster", balanced=False, max_iter=30, fill=True)))


@query("prb_5_identity_probe", None)
def _(spark, d):
    return rounded(P.holdout_probe(coords(spark, d), "vec_id", "label", COORDS, 7, max_iter=20))


@query("prb_6_context_probe", None)
def _(spark, d):
    return rounded(P.holdout_probe(coords(spark, d), "vec_id", "partition", COORDS, 7, max_iter=20))


@query("prb_7_ridge_one_feature", """WITH r AS (SELECT l_quantity AS x, l_extendedprice/1000.0::DOUBLE AS y, l_orderkey%5=0 AS held FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM r WHERE NOT held),
b AS (SELECT sum((x-mx)*(y-my))/(sum((x-mx)*(x-mx))+1) AS beta, any_value(mx) AS mx, any_value(my) AS my FROM r, m WHERE NOT held), p AS (SELECT y, my+beta*(x-mx) AS f FROM r, b WHERE held)
SELECT count(*) AS n, round(1-sum((y-f)*(y-f))/(var_pop(y)*count(*)),6) AS r2, round(avg(abs(y-f)),6) AS mae FROM p""")
def _(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    held = F.col("l_orderkey") % 5 == 0
    return rounded(P.ridge_probe(r.where(~held), r.where(held), ["x"], "y", standardize=False))


@query("prb_7_ridge_embedding", None)
def _(spark, d):
    a, b = parts(spark, d)
    return rounded(P.ridge_probe(a, b, COORDS, "speed"))


@query("prb_8_recoverability", None)
def _(spark, d):
    c = coords(spark, d)
    one = P.recoverability(c, "vec_id", COORDS[:3], "cluster", 50000, 3, max_iter=20)
    two = P.recoverability(c, "vec_id", COORDS[3:], "cluster", 50000, 3, max_iter=20)
    return rounded(P.scores_table({"first_half": one, "second_half": two}))


@query("met_1_classification_scores", f"""WITH {LAB}, ct AS (SELECT seed, label AS t, cluster AS g, count(*)::DOUBLE AS n FROM lab GROUP BY ALL), x AS (SELECT seed, t AS l, sum(n) AS nt, sum(CASE WHEN t=g THEN n ELSE 0 END) AS tp FROM ct GROUP BY ALL), y AS (SELECT seed, g AS l, sum(n) AS np FROM ct GROUP BY ALL),
j AS (SELECT seed, l, coalesce(nt,0) AS nt, coalesce(np,0) AS np, coalesce(tp,0) AS tp FROM x FULL JOIN y USING (seed, l))
SELECT seed, sum(nt)::BIGINT AS n, round(sum(tp)/sum(nt),6) AS accuracy, round(avg(CASE WHEN nt>0 THEN tp/nt END),6) AS balanced_accuracy, round(avg(2*tp/(nt+np)),6) AS macro_f1 FROM j GROUP BY seed""")
def _(spark, d):
    s = P.classification_scores(labelings(spark, d), "label", "cluster", ["seed"])
    return rounded(s.select("seed", "n", "accuracy", "balanced_accuracy", "macro_f1"))


@query("met_2_majority_chance", "WITH c AS (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY lang), h AS (SELECT avg(r) AS ba FROM (SELECT lang, avg((lang='en')::INT) AS r FROM documents GROUP BY lang)) SELECT round(max(n)/sum(n),6) AS majority, round(1.0/count(*),6) AS chance, round(any_value(ba)*count(*),6) AS chance_ratio FROM c, h")
def _(spark, d):
    s = P.classification_scores(table(spark, d, "documents").select("lang", F.lit("en").alias("guess")), "lang", "guess")
    return rounded(s.select("majority", "chance", "chance_ratio"))


@query("met_3_regression_scores", "SELECT l_returnflag, count(*) AS n, round(1-sum(pow(l_extendedprice-l_quantity*1500,2))/(var_pop(l_extendedprice)*count(*)),6) AS r2, round(avg(abs(l_extendedprice-l_quantity*1500)),6) AS mae FROM lineitem GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return rounded(P.regression_scores(p, "l_extendedprice", "guess", ["l_returnflag"]))


# ---- plans -------------------------------------------------------------------------------------


def evaluated(spark, d):
    e = embeddings(spark, d).withColumn("unit", F.col("vec_id") % 20).withColumn("e1", F.col("embedding")[0].cast("double"))
    e = e.withColumn("context", F.col("label"))
    return V.held_out(e, "vec_id", "embedding", seed_centres(spark, d), 11, ["e1"], "unit", "context")


@query("wrk_1_held_out_evaluation", None)
def _(spark, d):
    return rounded(evaluated(spark, d))


@query("wrk_1_held_out_claims", None)
def _(spark, d):
    return V.claims(evaluated(spark, d), D.CLAIMS_SET1, {"eta_e1": "speed_eta"})


@query("wrk_2_dry_run", None)
def _(spark, d):
    c = coords(spark, d).withColumn("extreme", F.abs("e1") > 0.2).withColumn("v", L.vector_of(COORDS))
    return rounded(V.dry_run(c.withColumnRenamed("cluster", "context"), "vec_id", "v", COORDS, "speed", "context", 3, 2, 20260822, ["extreme"], probe_iterations=20))
