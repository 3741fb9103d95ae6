"""Bindings of effect sizes, profiles and rank statistics."""

from pyspark.sql import functions as F

from boutwise.operators import agreement as G
from boutwise.operators import effects as X
from boutwise.operators import quality as Q

from .agreement import ALIGN, DIST_LABEL, js_sql, mapping
from .base import EMB, K, LAB, SEEDS, embeddings, labelings, query, rounded, table

FEATS = ["e1", "e2", "e3", "e4"]
FLAB = LAB + """,
f AS (SELECT l.seed, l.cluster, l.label, l.partition, u.feature, u.v FROM lab l JOIN (
  SELECT vec_id, unnest(['e1','e2','e3','e4']) AS feature, unnest(e[1:4]) AS v FROM emb) u USING (vec_id)),
gm AS (SELECT seed, feature, avg(v) AS m, var_pop(v) AS var, count(*) AS n FROM f GROUP BY ALL),
cm AS (SELECT seed, feature, cluster, avg(v) AS cm, count(*) AS cn FROM f GROUP BY ALL),
eff AS (SELECT seed, feature, any_value(n) AS n, sum(cn*(cm-m)*(cm-m))/any_value(n*var) AS eta_squared, (max(cm)-min(cm))/any_value(sqrt(var)) AS standardized_mean_range
  FROM cm JOIN gm USING (seed, feature) GROUP BY ALL)"""


def featured(spark, d, mapped=False):
    """Embedding rows per seed with four coordinates as plain features."""
    lab = labelings(spark, d)
    e = embeddings(spark, d).select("vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATS)])
    out = lab.join(e, "vec_id")
    if mapped:
        out = G.apply_mapping(out, mapping(spark, d), ["seed", "cluster"]).drop("cluster").withColumnRenamed("aligned", "cluster")
    return out


def effs(spark, d):
    return X.effect_sizes(X.group_moments(featured(spark, d), "cluster", FEATS, ["seed"]), ["seed"])


@query("eff_1_eta_squared", f"WITH {FLAB} SELECT seed, feature, n, round(eta_squared,6) AS eta_squared FROM eff")
def _(spark, d):
    return rounded(effs(spark, d).select("seed", "feature", "n", "eta_squared"))


@query("eff_1_eta_squared_documents", """WITH m AS (SELECT avg(n_chars) AS m, var_pop(n_chars)*count(*) AS sst FROM documents), g AS (SELECT lang, avg(n_chars) AS gm, count(*) AS n FROM documents GROUP BY lang)
SELECT 'n_chars' AS feature, round(sum(n*(gm-m)*(gm-m))/any_value(sst),6) AS eta_squared FROM g, m""")
def _(spark, d):
    m = X.group_moments(table(spark, d, "documents"), "lang", ["n_chars"])
    return rounded(X.effect_sizes(m).select("feature", "eta_squared"))


@query("eff_2_standardized_mean_range", f"WITH {FLAB} SELECT seed, feature, round(standardized_mean_range,6) AS standardized_mean_range FROM eff")
def _(spark, d):
    return rounded(effs(spark, d).select("seed", "feature", "standardized_mean_range"))


QS = ", ".join(f"round(quantile_cont(v,{q}),6) AS {n}" for n, q in X.GROUP_PROBS.items())


@query("eff_3_group_summary", f"""WITH s AS (SELECT event_type, value AS v FROM events) SELECT event_type, count(*) AS n, round(count(*)/(SELECT count(*) FROM s),6) AS fraction,
round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max, {QS}, round(quantile_cont(v,0.75)-quantile_cont(v,0.25),6) AS iqr FROM s GROUP BY event_type""")
def _(spark, d):
    return rounded(X.group_summary(table(spark, d, "events"), "event_type", "value"))


PROFILES = """f AS (SELECT l.seed, l.aligned AS cluster, l.partition, u.feature, u.v FROM (SELECT l.*, m.aligned FROM lab l JOIN mapping m USING (seed, cluster)) l JOIN (
  SELECT vec_id, unnest(['e1','e2','e3','e4']) AS feature, unnest(e[1:4]) AS v FROM emb) u USING (vec_id))"""
RANKS = """, rk AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY x)+(count(*) OVER (PARTITION BY {g}, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY {g} ORDER BY y)+(count(*) OVER (PARTITION BY {g}, y)-1)/2.0 AS ry FROM xy),
rho AS (SELECT {g}, count(*) AS n, CASE WHEN count(*)>=3 AND stddev_pop(rx)>0 AND stddev_pop(ry)>0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL)"""
XSEED = f"WITH RECURSIVE {ALIGN}, {PROFILES}, pm AS (SELECT seed, feature, cluster, avg(v) AS m, median(v) AS md FROM f GROUP BY ALL), xy AS (SELECT a.feature, a.seed AS seed_a, b.seed AS seed_b, a.m AS x, b.m AS y FROM pm a JOIN pm b ON a.feature=b.feature AND a.cluster=b.cluster AND a.seed<b.seed)" + RANKS.format(g="feature, seed_a, seed_b")


@query("eff_4_profiles", f"""WITH {FLAB}, g AS (SELECT * FROM (SELECT DISTINCT seed, feature FROM f) CROSS JOIN (SELECT unnest(range(8)) AS cluster))
SELECT seed, feature, cluster, coalesce(n,0) AS n, round(mean,6) AS mean, round(median,6) AS median FROM g LEFT JOIN (SELECT seed, feature, cluster, count(*) AS n, avg(v) AS mean, median(v) AS median FROM f GROUP BY ALL) USING (seed, feature, cluster)""")
def _(spark, d):
    return rounded(X.profiles(featured(spark, d), "cluster", FEATS, K, ["seed"]))


@query("eff_5_rank_features", f"WITH {FLAB} SELECT seed, feature, n, round(eta_squared,6) AS eta_squared, round(standardized_mean_range,6) AS standardized_mean_range, row_number() OVER (PARTITION BY seed ORDER BY eta_squared DESC, feature) AS rank FROM eff")
def _(spark, d):
    return rounded(X.rank_features(effs(spark, d), ["seed"]))


SEEDAGG = ", ".join(f"round({f}({m}),6) AS {m}_{n}" for m in ("eta_squared", "standardized_mean_range") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("eff_6_rank_across_seeds", f"WITH {FLAB} SELECT feature, count(*) AS seed_count, {SEEDAGG}, row_number() OVER (ORDER BY avg(eta_squared) DESC, feature) AS rank FROM eff GROUP BY feature")
def _(spark, d):
    return rounded(X.rank_across_seeds(effs(spark, d), "eta_squared", "standardized_mean_range"))


@query("eff_6_categorical_effects", f"""WITH {LAB}, c AS (SELECT seed, cluster, unnest(['label','partition']) AS feature, unnest([label::VARCHAR, partition]) AS category FROM lab),
ct AS (SELECT seed, feature, category AS a, cluster AS b, count(*)::DOUBLE AS n FROM c GROUP BY ALL), t AS (SELECT seed, feature, sum(n) AS s FROM ct GROUP BY ALL),
ra AS (SELECT seed, feature, a, sum(n) AS na FROM ct GROUP BY ALL), rb AS (SELECT seed, feature, b, sum(n) AS nb FROM ct GROUP BY ALL),
ha AS (SELECT seed, feature, -sum(na/s*ln(na/s)) AS h, count(*) AS k FROM ra JOIN t USING (seed, feature) GROUP BY ALL), hb AS (SELECT seed, feature, -sum(nb/s*ln(nb/s)) AS h, count(*) AS k FROM rb JOIN t USING (seed, feature) GROUP BY ALL),
mi AS (SELECT seed, feature, sum(n/s*ln(n*s/(na*nb))) AS mi, s*(sum(n*n/(na*nb))-1) AS chi2, s FROM ct JOIN ra USING (seed, feature, a) JOIN rb USING (seed, feature, b) JOIN t USING (seed, feature) GROUP BY seed, feature, s)
SELECT seed, feature, ha.k AS categories, round(2*mi/(ha.h+hb.h),6) AS nmi, round(sqrt(chi2/s/(least(ha.k,hb.k)-1)),6) AS cramers_v FROM mi JOIN ha USING (seed, feature) JOIN hb USING (seed, feature)""")
def _(spark, d):
    return rounded(X.categorical_effects(labelings(spark, d), "cluster", ["label", "partition"], ["seed"]))


@query("eff_7_spearman", f"""WITH xy AS (SELECT lang, avg(n_chars) AS x, count(*) AS y FROM documents GROUP BY lang, source){RANKS.format(g='lang')} SELECT lang, round(rho,6) AS rho, n FROM rho""")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("x"), F.count(F.lit(1)).alias("y"))
    return rounded(X.spearman(g, "x", "y", ["lang"]))


@query("eff_7_ranked_correlation", f"""WITH xy AS (SELECT 1 AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem){RANKS.format(g='g')} SELECT round(rho,6) AS rho, n FROM rho""")
def _(spark, d):
    return rounded(X.ranked_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def seed_profiles(spark, d):
    return X.profiles(featured(spark, d, mapped=True), "cluster", FEATS, K, ["seed"])


@query("eff_8_profile_pairs", f"{XSEED} SELECT feature, seed_a, seed_b, round(rho,6) AS rho, n FROM rho")
def _(spark, d):
    return rounded(X.profile_pairs(seed_profiles(spark, d), SEEDS, "mean"))


@query("eff_8_profile_pair_summary", f"{XSEED} SELECT feature, count(*) AS pairs, count(rho) AS finite_pairs, round(avg(rho),6) AS mean_rho, round(median(rho),6) AS median_rho, round(min(rho),6) AS min_rho, round(max(rho),6) AS max_rho FROM rho GROUP BY feature")
def _(spark, d):
    return rounded(X.profile_pair_summary(X.profile_pairs(seed_profiles(spark, d), SEEDS, "mean")))


REPRO = f"WITH {FLAB}, a AS (SELECT seed, feature, cluster, avg(v) AS x FROM f WHERE partition='train' GROUP BY ALL), b AS (SELECT seed, feature, cluster, avg(v) AS y FROM f WHERE partition='validation' GROUP BY ALL), xy AS (SELECT * FROM a JOIN b USING (seed, feature, cluster))" + RANKS.format(g="seed, feature")


def reproducibility(spark, d):
    p = X.profiles(featured(spark, d), "cluster", FEATS, K, ["partition", "seed"])
    return X.profile_reproducibility(p.where(F.col("partition") == "train"), p.where(F.col("partition") == "validation"))


@query("eff_9_profile_reproducibility", f"{REPRO} SELECT seed, feature, round(rho,6) AS rho, n FROM rho")
def _(spark, d):
    return rounded(reproducibility(spark, d))


@query("eff_10_directional_consistency", f"""WITH RECURSIVE {ALIGN}, {PROFILES}, pm AS (SELECT seed, cluster, avg(v) AS m FROM f WHERE feature='e1' GROUP BY ALL),
dd AS (SELECT cluster, CASE WHEN m > 0.01 THEN 'positive' WHEN m < -0.01 THEN 'negative' ELSE 'neutral' END AS d FROM pm),
g AS (SELECT cluster, count_if(d='positive')::BIGINT AS positive, count_if(d='negative')::BIGINT AS negative, count_if(d='neutral')::BIGINT AS neutral FROM dd GROUP BY cluster)
SELECT cluster, positive, negative, neutral, 0::BIGINT AS missing, CASE WHEN positive>=negative AND positive>=neutral THEN 'positive' WHEN negative>=neutral THEN 'negative' ELSE 'neutral' END AS modal_direction,
round(greatest(positive,negative,neutral)/(positive+negative+neutral),6) AS consistency FROM g""")
def _(spark, d):
    p = seed_profiles(spark, d).where((F.col("feature") == "e1") & (F.col("n") > 0))
    return rounded(X.directional_consistency(p.withColumn("direction", Q.direction(F.col("mean"), 0.01))))


@query("eff_11_kruskal_wallis", """WITH s AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem), r AS (SELECT g, v, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0 AS r FROM s),
a AS (SELECT sum(sr*sr/n) AS q, count(*) AS groups FROM (SELECT g, sum(r)::DOUBLE AS sr, count(*)::DOUBLE AS n FROM r GROUP BY g)), t AS (SELECT sum(c*c*c-c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM s GROUP BY v)), n AS (SELECT count(*)::DOUBLE AS n FROM s)
SELECT n::BIGINT AS n, groups, round(h,4) AS h, round(exp(-h/2),9) AS p_value FROM (SELECT n, groups, (12/(n*(n+1))*q-3*(n+1))/(1-ties/(n*n*n-n)) AS h FROM a, t, n)""")  # three groups: the tail of two degrees of freedom
def _(spark, d):
    k = X.kruskal_wallis(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return k.select("n", "groups", F.round("h", 4).alias("h"), F.round("p_value", 9).alias("p_value"))


RQ = ", ".join(f"round(quantile_cont(v,{q}),6) AS {n}" for n, q in X.ROBUST_PROBS.items())


@query("eff_12_robust_summary", f"SELECT count(*) AS n, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max, {RQ} FROM (SELECT l_extendedprice AS v FROM lineitem)")
def _(spark, d):
    return rounded(X.robust_summary(table(spark, d, "lineitem"), "l_extendedprice"))


@query("eff_13_summarize", f"WITH {FLAB} SELECT feature, count(*) AS n, round(avg(eta_squared),6) AS mean, round(stddev_pop(eta_squared),6) AS std, round(min(eta_squared),6) AS min, round(max(eta_squared),6) AS max FROM eff GROUP BY feature")
def _(spark, d):
    return rounded(X.summarize(effs(spark, d), "eta_squared", ["feature"]))


@query("eff_14_axis_summary", f"""{XSEED}, p AS (SELECT feature, avg(rho) AS mean_rho, min(rho) AS min_rho FROM rho GROUP BY feature),
f2 AS (SELECT l.seed, l.cluster, l.partition, u.feature, u.v FROM lab l JOIN (SELECT vec_id, unnest(['e1','e2','e3','e4']) AS feature, unnest(e[1:4]) AS v FROM emb) u USING (vec_id)),
xy2 AS (SELECT a.seed, a.feature, a.x, b.y FROM (SELECT seed, feature, cluster, avg(v) AS x FROM f2 WHERE partition='train' GROUP BY ALL) a JOIN (SELECT seed, feature, cluster, avg(v) AS y FROM f2 WHERE partition='validation' GROUP BY ALL) b USING (seed, feature, cluster)),
rk2 AS (SELECT *, rank() OVER (PARTITION BY seed, feature ORDER BY x) AS rx, rank() OVER (PARTITION BY seed, feature ORDER BY y) AS ry FROM xy2), rho2 AS (SELECT seed, feature, corr(rx, ry) AS rho FROM rk2 GROUP BY ALL)
SELECT CASE WHEN feature='e1' THEN 'first' ELSE 'second' END AS axis, feature, round(mean_rho,6) AS mean_rho, round(min_rho,6) AS min_rho, round(avg(rho2.rho),6) AS train_held_rho FROM p JOIN rho2 USING (feature) WHERE feature IN ('e1','e3','e4') GROUP BY feature, mean_rho, min_rho""")
def _(spark, d):
    s = X.profile_pair_summary(X.profile_pairs(seed_profiles(spark, d), SEEDS, "mean"))
    return rounded(X.axis_summary(s, reproducibility(spark, d), {"first": ["e1"], "second": ["e3", "e4"]}))


@query("eff_15_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice),6) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(X.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("eff_16_substructure", f"""WITH {LAB}, c AS (SELECT seed, label, cluster, count(*)::DOUBLE AS n FROM lab GROUP BY ALL), t AS (SELECT seed, label, sum(n) AS s FROM c GROUP BY ALL)
SELECT seed, label, s::BIGINT AS n, count(*) AS occupied, count_if(n/s>=0.05)::BIGINT AS at_least_5pct, count_if(n/s>=0.1)::BIGINT AS at_least_10pct, arg_max(cluster, n*100-cluster) AS dominant_cluster, round(max(n/s),6) AS dominant_share,
round(-sum(n/s*ln(n/s))/ln(8),6) AS normalized_entropy, round(exp(-sum(n/s*ln(n/s))),6) AS effective_number FROM c JOIN t USING (seed, label) GROUP BY seed, label, s""")
def _(spark, d):
    return rounded(X.substructure(labelings(spark, d), "label", "cluster", K, ["seed"]))


@query("eff_17_followup_score", f"""WITH {LAB}{DIST_LABEL}{js_sql('label')}, e AS (SELECT label, avg(x) AS eff FROM (SELECT label, seed, exp(-sum(p*ln(p))) AS x FROM dist GROUP BY ALL) GROUP BY label),
j AS (SELECT label, avg(js) AS js FROM js GROUP BY label)
SELECT label, round(0.40*least(greatest((eff-1)/3,0),1)+0.35*0.5+0.25*least(greatest(js,0),1),6) AS score, row_number() OVER (ORDER BY 0.40*least(greatest((eff-1)/3,0),1)+0.35*0.5+0.25*least(greatest(js,0),1) DESC, label) AS rank FROM e JOIN j USING (label)""")
def _(spark, d):
    lab = labelings(spark, d)
    e = X.substructure(lab, "label", "cluster", K, ["seed"]).groupBy("label").agg(F.avg("effective_number").alias("eff"))
    j = G.js_similarity(G.contingency(lab, "label", "cluster", ["seed"]), "seed", "cluster", SEEDS, ["label"]).groupBy("label").agg(F.avg("js_similarity").alias("js"))
    s = e.join(j, "label").withColumn("feature", F.col("label")).withColumn("score", X.followup_score(F.col("eff"), F.lit(0.5), F.col("js")))
    return rounded(X.rank_features(s, metric="score").select("label", "score", "rank"))


@query("eff_18_aligned_consistency", f"""WITH RECURSIVE {ALIGN}, al AS (SELECT l.partition, l.seed, m.aligned, l.label FROM lab l JOIN mapping m USING (seed, cluster)),
dist AS (SELECT partition, aligned, seed, label AS cat, n/sum(n) OVER (PARTITION BY partition, aligned, seed) AS p FROM (SELECT partition, aligned, seed, label, count(*)::DOUBLE AS n FROM al GROUP BY ALL)){js_sql('partition, aligned')}
SELECT partition, aligned, round(avg(js),6) AS mean_js, round(min(js),6) AS min_js, count(*) AS pairs FROM js GROUP BY ALL""")
def _(spark, d):
    al = G.apply_mapping(labelings(spark, d), mapping(spark, d), ["seed", "cluster"])
    counts = G.contingency(al, "aligned", "label", ["partition", "seed"])
    js = G.js_similarity(counts, "seed", "label", SEEDS, ["partition", "aligned"])
    return rounded(js.groupBy("partition", "aligned").agg(F.avg("js_similarity").alias("mean_js"), F.min("js_similarity").alias("min_js"), F.count(F.lit(1)).alias("pairs")))


BQ = ", ".join(f"round(quantile_cont(o_totalprice,{q}),6) AS {n}" for n, q in X.BOX_PROBS.items())


@query("eff_19_box_stats", f"SELECT o_orderpriority, {BQ} FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(X.box_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))
