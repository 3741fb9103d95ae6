"""Bindings of the agreement metrics: lang x source, seed labelings, units x event types."""

from pyspark.sql import functions as F

from boutwise.operators import agreement as G

from .base import BOUTS, EMB, K, LAB, SAMPLES, SEEDS, embeddings, labelings, query, rounded, samples, table

DOCS = "ct AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL)"
LABCT = LAB + ", ct AS (SELECT label AS a, cluster AS b, seed, count(*) AS n FROM lab GROUP BY ALL)"
PAIRS = LAB + """,
pairs AS (SELECT x.seed AS seed_a, y.seed AS seed_b, x.cluster AS la, y.cluster AS lb, x.label, x.vec_id FROM lab x JOIN lab y ON x.vec_id=y.vec_id AND x.seed<y.seed),
pct AS (SELECT seed_a, seed_b, la AS a, lb AS b, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL)"""
# per group g: all classic measures from cells, written with margins joined back
MEAS = """
ra AS (SELECT {g}, a, sum(n)::DOUBLE AS na, max(n) AS ta FROM {ct} GROUP BY ALL),
rb AS (SELECT {g}, b, sum(n)::DOUBLE AS nb, max(n) AS tb FROM {ct} GROUP BY ALL),
tt AS (SELECT {g}, sum(n)::DOUBLE AS nn, sum(n*(n-1)/2.0)::DOUBLE AS pc FROM {ct} GROUP BY ALL),
sa AS (SELECT {g}, sum(na*(na-1)/2) AS pa, -sum(na/nn*ln(na/nn)) AS ha, sum(ta)/any_value(nn) AS purity_a FROM ra JOIN tt USING ({g}) GROUP BY ALL),
sb AS (SELECT {g}, sum(nb*(nb-1)/2) AS pb, -sum(nb/nn*ln(nb/nn)) AS hb, sum(tb)/any_value(nn) AS purity_b FROM rb JOIN tt USING ({g}) GROUP BY ALL),
mm AS (SELECT {g}, sum(n/nn*ln(n*nn/(na*nb))) AS mi FROM {ct} c JOIN ra USING ({g}, a) JOIN rb USING ({g}, b) JOIN tt USING ({g}) GROUP BY ALL),
meas AS (SELECT {g}, nn, mi, ha, hb, purity_a, purity_b, (pc-pa*pb/(nn*(nn-1)/2))/((pa+pb)/2-pa*pb/(nn*(nn-1)/2)) AS ari, 2*mi/(ha+hb) AS nmi,
  mi/ha AS homogeneity, mi/hb AS completeness FROM tt JOIN sa USING ({g}) JOIN sb USING ({g}) JOIN mm USING ({g}))"""
DOCG = DOCS.replace("SELECT lang", "SELECT 1 AS g, lang") + "," + MEAS.format(g="g", ct="ct")
SEEDG = LABCT + "," + MEAS.format(g="seed", ct="ct")
PAIRG = PAIRS + "," + MEAS.format(g="seed_a, seed_b", ct="pct")


def docs(spark, d):
    return G.contingency(table(spark, d, "documents"), "lang", "source")


def seedct(spark, d):
    return G.contingency(labelings(spark, d), "label", "cluster", ["seed"])


@query("agr_0_contingency", f"WITH {DOCS} SELECT a AS lang, b AS source, n FROM ct")
def _(spark, d):
    return docs(spark, d)


@query("agr_0_contingency_dense", f"""WITH {LABCT}, g AS (SELECT DISTINCT label AS a, unnest(range(8)) AS b FROM emb)
SELECT g.a AS label, g.b AS cluster, coalesce(ct.n, 0) AS n FROM g LEFT JOIN ct ON ct.a=g.a AND ct.b=g.b AND ct.seed=11""")
def _(spark, d):
    return rounded(G.dense_contingency(labelings(spark, d).where(F.col("seed") == 11), "label", "cluster", K))


@query("agr_1_adjusted_rand", f"WITH {DOCG} SELECT round(ari,6) AS ari FROM meas")
def _(spark, d):
    return rounded(G.measures(docs(spark, d), "lang", "source").select("ari"))


@query("agr_1_adjusted_rand_by_seed", f"WITH {SEEDG} SELECT seed, round(ari,6) AS ari FROM meas")
def _(spark, d):
    return rounded(G.measures(seedct(spark, d), "label", "cluster", ["seed"]).select("seed", "ari"))


@query("agr_2_normalized_mi", f"WITH {DOCG} SELECT round(nmi,6) AS nmi, round(mi,6) AS mi FROM meas")
def _(spark, d):
    return rounded(G.measures(docs(spark, d), "lang", "source").select("nmi", "mi"))


@query("agr_3_adjusted_mi", f"""WITH {DOCG}, cells AS (SELECT na AS a, nb AS b, nn AS t FROM ra, rb, tt),
grid AS (SELECT a, b, t, unnest(range(greatest(1,(a+b-t)::BIGINT), least(a,b)::BIGINT+1)) AS k FROM cells),
e AS (SELECT sum(k/t*ln(k*t/(a*b))*exp(lgamma(a+1)+lgamma(b+1)+lgamma(t-a+1)+lgamma(t-b+1)-lgamma(t+1)-lgamma(k+1)-lgamma(a-k+1)-lgamma(b-k+1)-lgamma(t-a-b+k+1))) AS emi FROM grid)
SELECT round(mi,6) AS mi, round(emi,6) AS emi, round((mi-emi)/((ha+hb)/2-emi),6)+0.0::DOUBLE AS ami FROM meas, e""")
def _(spark, d):
    return rounded(G.adjusted_mi(docs(spark, d), "lang", "source"))


@query("agr_4_v_measure", f"WITH {SEEDG} SELECT seed, round(homogeneity,6) AS homogeneity, round(completeness,6) AS completeness, round(2*homogeneity*completeness/(homogeneity+completeness),6) AS v_measure FROM meas")
def _(spark, d):
    return rounded(G.measures(seedct(spark, d), "label", "cluster", ["seed"]).select("seed", "homogeneity", "completeness", "v_measure"))


@query("agr_5_conditional_entropy", f"WITH {SEEDG} SELECT seed, round((ha-mi)/ha,6) AS h_a_given_b, round((hb-mi)/hb,6) AS h_b_given_a FROM meas")
def _(spark, d):
    return rounded(G.measures(seedct(spark, d), "label", "cluster", ["seed"]).select("seed", "h_a_given_b", "h_b_given_a"))


@query("agr_6_cramers_v", f"""WITH {DOCS}, ra AS (SELECT a, sum(n)::DOUBLE AS na FROM ct GROUP BY a), rb AS (SELECT b, sum(n)::DOUBLE AS nb FROM ct GROUP BY b),
t AS (SELECT sum(n)::DOUBLE AS nn FROM ct), g AS (SELECT coalesce(n,0) AS n, na*nb/nn AS e, nn FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN ct USING (a,b))
SELECT round(sum((n-e)*(n-e)/e),6) AS chi2, round(sqrt(sum((n-e)*(n-e)/e)/any_value(nn)/(least((SELECT count(*) FROM ra),(SELECT count(*) FROM rb))-1)),6) AS cramers_v FROM g""")
def _(spark, d):
    return rounded(G.cramers_v(docs(spark, d), "lang", "source").select("chi2", "cramers_v"))


@query("agr_6_cramers_v_orders", """WITH ct AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
ra AS (SELECT a, sum(n)::DOUBLE AS na FROM ct GROUP BY a), rb AS (SELECT b, sum(n)::DOUBLE AS nb FROM ct GROUP BY b),
t AS (SELECT sum(n)::DOUBLE AS nn FROM ct), g AS (SELECT coalesce(n,0) AS n, na*nb/nn AS e, nn FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN ct USING (a,b))
SELECT round(sqrt(sum((n-e)*(n-e)/e)/any_value(nn)/(least((SELECT count(*) FROM ra),(SELECT count(*) FROM rb))-1)),6) AS cramers_v FROM g""")
def _(spark, d):
    ct = G.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(G.cramers_v(ct, "o_orderstatus", "o_orderpriority").select("cramers_v"))


@query("agr_7_purity", f"WITH {SEEDG} SELECT seed, round(purity_b,6) AS by_cluster, round(purity_a,6) AS by_class FROM meas")
def _(spark, d):
    m = G.measures(seedct(spark, d), "label", "cluster", ["seed"])
    return rounded(m.select("seed", F.col("purity_b").alias("by_cluster"), F.col("purity_a").alias("by_class")))


@query("agr_8_entropy", f"""WITH {DOCS}, t AS (SELECT a, sum(n)::DOUBLE AS s, count(*) AS c FROM ct GROUP BY a), h AS (SELECT a, -sum(n/s*ln(n/s)) AS h, any_value(c) AS c FROM ct JOIN t USING (a) GROUP BY a)
SELECT a AS lang, round(h,6) AS entropy, round(h/ln(c),6) AS normalized_entropy, round(exp(h),6) AS effective_number FROM h""")
def _(spark, d):
    return rounded(G.entropy(docs(spark, d), by=["lang"]))


@query("agr_9_concentration", f"""WITH ct AS (SELECT user_id AS a, event_type AS b, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT b, sum(n)::DOUBLE AS s FROM ct GROUP BY b), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rn FROM ct JOIN t USING (b))
SELECT b AS event_type, s::BIGINT AS total, count(*) AS categories, round(1/sum((n/s)*(n/s)),6) AS inverse_simpson, round(exp(-sum(n/s*ln(n/s))),6) AS effective_number,
 round(-sum(n/s*ln(n/s)),6) AS entropy, round(max(n/s),6) AS max_share, round(sum(CASE WHEN rn<=3 THEN n/s END),6) AS top3_share, round(sum(CASE WHEN rn<=5 THEN n/s END),6) AS top5_share,
 max(CASE WHEN rn=1 THEN a END) AS dominant FROM r GROUP BY b, s""")
def _(spark, d):
    ct = G.contingency(table(spark, d, "events"), "user_id", "event_type")
    return rounded(G.concentration(ct, "user_id", "event_type"))


TYPES = ["click", "error", "purchase", "signup", "view"]
TYPECODE = "(list_position(['click','error','purchase','signup','view'], event_type)-1)"
PROFILE = f"""ct AS (SELECT user_id AS fish_id, {TYPECODE} AS b, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT fish_id, sum(n)::DOUBLE AS s FROM ct GROUP BY 1),
pr AS (SELECT fish_id, s::BIGINT AS n, -sum(n/s*ln(n/s))/ln(5) AS normalized_entropy, arg_max(b, n*100-b)::BIGINT AS dominant_cluster, max(n/s) AS dominant_share FROM ct JOIN t USING (fish_id) GROUP BY fish_id, s)"""


def typed(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("fish_id"), "event_type")
    return e.withColumn("code", F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1)


@query("agr_10_category_profiles", f"WITH {PROFILE} SELECT fish_id, n, round(normalized_entropy,6) AS normalized_entropy, dominant_cluster, round(dominant_share,6) AS dominant_share FROM pr")
def _(spark, d):
    return rounded(G.category_profiles(typed(spark, d), "fish_id", "code", 5).drop("counts"))


@query("agr_10_category_summary", f"""WITH {PROFILE} SELECT count(*) AS categories, round(avg(normalized_entropy),6) AS mean_entropy, round(stddev_pop(normalized_entropy),6) AS std_entropy,
round(min(normalized_entropy),6) AS min_entropy, round(max(normalized_entropy),6) AS max_entropy, round(avg(dominant_share),6) AS mean_dominant, round(max(dominant_share),6) AS max_dominant, round(median(n),6) AS median_n FROM pr""")
def _(spark, d):
    return rounded(G.category_summary(G.category_profiles(typed(spark, d), "fish_id", "code", 5)))


@query("agr_11_self_consistency", f"""WITH c AS (SELECT user_id AS u, {', '.join(f"count(*) FILTER (event_type='{t}') AS c{i}" for i, t in enumerate(TYPES))} FROM events GROUP BY 1),
h AS (SELECT u, {', '.join(f'c{i}/(c0+c1+c2+c3+c4)::DOUBLE AS h{i}' for i in range(5))} FROM c),
t AS (SELECT u, {', '.join(f'c{i}-floor(c{i}*0.1::DOUBLE) AS c{i}' for i in range(5))} FROM c),
q AS (SELECT u, {', '.join(f'c{i}/(c0+c1+c2+c3+c4)::DOUBLE AS q{i}' for i in range(5))} FROM t),
n AS (SELECT q.u, h.u AS v FROM q, h QUALIFY row_number() OVER (PARTITION BY q.u ORDER BY sqrt({'+'.join(f'(q{i}-h{i})*(q{i}-h{i})' for i in range(5))}), h.u)=1)
SELECT count(*) AS units, round(avg((u=v)::INT),6) AS accuracy, round(1.0/count(*),6) AS chance FROM n""")
def _(spark, d):
    return rounded(G.self_consistency(typed(spark, d), "fish_id", "event_type", TYPES))


@query("agr_12_within_clusters", f"""WITH {LABCT}, t AS (SELECT seed, b, sum(n)::DOUBLE AS s, max(n) AS m FROM ct GROUP BY ALL), h AS (SELECT seed, b, exp(-sum(n/s*ln(n/s))) AS e FROM ct JOIN t USING (seed,b) GROUP BY ALL)
SELECT seed, b AS cluster, a AS label, n, round(n/s,6) AS fraction, s::BIGINT AS n_a, round(e,6) AS effective_number, round(m/s,6) AS dominant_share FROM ct JOIN t USING (seed,b) JOIN h USING (seed,b)""")
def _(spark, d):
    return rounded(G.within(seedct(spark, d), "cluster", "label", ["seed"]))


ALIGN = LAB.replace("), (", "), (", 1) + """,
refl AS (SELECT x.seed, r.cluster AS rc, x.cluster AS cc, count(*)::BIGINT AS n FROM lab x JOIN lab r ON r.vec_id=x.vec_id AND r.seed=11 WHERE x.partition='train' GROUP BY ALL),
fullgrid AS (SELECT s.seed, i AS rc, j AS cc, coalesce(n,0) AS n FROM (SELECT DISTINCT seed FROM lab) s CROSS JOIN (SELECT unnest(range(8)) AS i) CROSS JOIN (SELECT unnest(range(8)) AS j) LEFT JOIN refl r ON r.seed=s.seed AND r.rc=i AND r.cc=j),
dp AS (SELECT seed, 0::BIGINT AS i, 0::BIGINT AS mask, 0::BIGINT AS total, '' AS path FROM (SELECT DISTINCT seed FROM lab)
  UNION ALL SELECT seed, i, mask, total, path FROM (SELECT d.seed, d.i+1 AS i, d.mask | (1::BIGINT << f.cc) AS mask, d.total+f.n AS total, d.path||f.cc AS path,
    row_number() OVER (PARTITION BY d.seed, d.mask | (1::BIGINT << f.cc) ORDER BY d.total+f.n DESC, d.path||f.cc) AS rn
    FROM dp d JOIN fullgrid f ON f.seed=d.seed AND f.rc=d.i AND (d.mask & (1::BIGINT << f.cc))=0 WHERE d.i<8) WHERE rn=1),
mapping AS (SELECT seed, CAST(substr(path, p::INT+1, 1) AS BIGINT) AS cluster, p AS aligned FROM dp, (SELECT unnest(range(8)) AS p) WHERE i=8)"""


def mapping(spark, d):
    train = labelings(spark, d).where(F.col("partition") == "train")
    return G.align_seeds(train, "vec_id", "seed", "cluster", K, SEEDS, 11)


@query("agr_13_align_labels", f"WITH RECURSIVE {ALIGN} SELECT seed, cluster, aligned FROM mapping")
def _(spark, d):
    return mapping(spark, d)


@query("agr_14_apply_mapping", f"WITH RECURSIVE {ALIGN} SELECT vec_id, l.seed, l.cluster, aligned, aligned IS NULL AS unmapped FROM lab l LEFT JOIN mapping m ON m.seed=l.seed AND m.cluster=l.cluster WHERE l.partition<>'train'")
def _(spark, d):
    held = labelings(spark, d).where(F.col("partition") != "train").select("vec_id", "seed", "cluster")
    return G.apply_mapping(held, mapping(spark, d), ["seed", "cluster"])


ALAB = ALIGN + ", al AS (SELECT l.vec_id, l.seed, m.aligned, l.label, l.partition FROM lab l JOIN mapping m USING (seed, cluster))"


@query("agr_15_aligned_confusion", f"""WITH RECURSIVE {ALAB}
SELECT x.seed, r.aligned AS reference, x.aligned, count(*) AS n FROM al x JOIN al r ON r.vec_id=x.vec_id AND r.seed=11 WHERE x.seed<>11 GROUP BY ALL""")
def _(spark, d):
    al = G.apply_mapping(labelings(spark, d).select("vec_id", "seed", "cluster"), mapping(spark, d), ["seed", "cluster"])
    wide = G.by_seed(al, "vec_id", "seed", "aligned", SEEDS)
    p = G.seed_pairs(wide, SEEDS).where(F.col("seed_a") == 11)
    ct = G.contingency(p, "label_a", "label_b", ["seed_b"])
    return ct.select(F.col("seed_b").alias("seed"), F.col("label_a").alias("reference"), F.col("label_b").alias("aligned"), "n")


@query("agr_15_aligned_agreement", f"""WITH RECURSIVE {ALAB}
SELECT x.seed AS seed_a, y.seed AS seed_b, round(avg((x.aligned=y.aligned)::INT),6) AS agreement FROM al x JOIN al y ON x.vec_id=y.vec_id AND x.seed<y.seed GROUP BY ALL""")
def _(spark, d):
    al = G.apply_mapping(labelings(spark, d).select("vec_id", "seed", "cluster"), mapping(spark, d), ["seed", "cluster"])
    wide = G.by_seed(al, "vec_id", "seed", "aligned", SEEDS)
    return rounded(G.pairwise_agreement(wide, SEEDS).select("seed_a", "seed_b", "agreement"))


def wide_labels(spark, d):
    return G.by_seed(labelings(spark, d), "vec_id", "seed", "cluster", SEEDS)


@query("agr_16_seed_pairs", f"""WITH {PAIRG} SELECT seed_a, seed_b, nn::BIGINT AS n, round(ari,6) AS ari, round(nmi,6) AS nmi, round(ag,6) AS agreement
FROM meas JOIN (SELECT seed_a, seed_b, sum(CASE WHEN a=b THEN n ELSE 0 END)/sum(n) AS ag FROM pct GROUP BY ALL) USING (seed_a, seed_b)""")
def _(spark, d):
    return rounded(G.pairwise_agreement(wide_labels(spark, d), SEEDS))


@query("agr_16_seed_pair_summary", f"""WITH {PAIRG}, u AS (SELECT 'ari' AS metric, ari AS v FROM meas UNION ALL SELECT 'nmi', nmi FROM meas)
SELECT metric, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max, round(median(v),6) AS median, round(quantile_cont(v,0.75)-quantile_cont(v,0.25),6) AS iqr FROM u GROUP BY metric""")
def _(spark, d):
    return rounded(G.summarize_pairs(G.pairwise_agreement(wide_labels(spark, d), SEEDS), ["ari", "nmi"]))




def js_sql(group):
    """SQL for the similarity from dist(group, seed, cat, p)."""
    on = " AND ".join(f"z.{c}=w.{c}" for c in group.split(", "))
    gz = ", ".join(f"z.{c}" for c in group.split(", "))
    return f""", grid AS (SELECT DISTINCT {group}, cat FROM dist), sd AS (SELECT DISTINCT {group}, seed FROM dist),
jp AS (SELECT {gz}, x.seed AS seed_a, y.seed AS seed_b, z.cat FROM grid z JOIN sd x ON {on.replace('w.', 'x.')} JOIN sd y ON {on.replace('w.', 'y.')} AND x.seed<y.seed),
jq AS (SELECT z.*, coalesce(x.p,0) AS p, coalesce(y.p,0) AS q FROM jp z LEFT JOIN dist x ON {on.replace('w.', 'x.')} AND x.cat=z.cat AND x.seed=z.seed_a LEFT JOIN dist y ON {on.replace('w.', 'y.')} AND y.cat=z.cat AND y.seed=z.seed_b),
js AS (SELECT {group}, seed_a, seed_b, 1-sqrt(greatest(0,sum((CASE WHEN p>0 THEN p*log2(2*p/(p+q)) ELSE 0 END + CASE WHEN q>0 THEN q*log2(2*q/(p+q)) ELSE 0 END)/2))) AS js FROM jq GROUP BY ALL)"""


DIST_LABEL = ", dist AS (SELECT label, seed, cluster AS cat, n/sum(n) OVER (PARTITION BY label, seed) AS p FROM (SELECT label, seed, cluster, count(*)::DOUBLE AS n FROM lab GROUP BY ALL))"


@query("agr_17_js_similarity", f"WITH {LAB}{DIST_LABEL}{js_sql('label')} SELECT label, seed_a, seed_b, round(js,6) AS js_similarity FROM js")
def _(spark, d):
    counts = G.contingency(labelings(spark, d), "label", "cluster", ["seed"])
    return rounded(G.js_similarity(counts, "seed", "cluster", SEEDS, ["label"]))


@query("agr_18_unit_occupancy", f"""WITH ct AS (SELECT user_id AS u, {TYPECODE} AS b, count(*)::DOUBLE AS n FROM events GROUP BY ALL), t AS (SELECT u, sum(n) AS s FROM ct GROUP BY u),
g AS (SELECT t.u, b, coalesce(n,0)/s AS f FROM t CROSS JOIN (SELECT unnest(range(5)) AS b) LEFT JOIN ct USING (u,b))
SELECT b AS code, count_if(f>0)::BIGINT AS units_with, round(min(f),6) AS min, round(max(f),6) AS max, round(quantile_cont(f,0.25),6) AS q25, round(median(f),6) AS median, round(quantile_cont(f,0.75),6) AS q75 FROM g GROUP BY b""")
def _(spark, d):
    return rounded(G.unit_occupancy(typed(spark, d), "fish_id", "code", 5))


@query("agr_19_contributors", f"WITH {LAB} SELECT cluster, count(DISTINCT label) AS n_label, count(DISTINCT partition) AS n_partition FROM lab WHERE seed=11 GROUP BY cluster")
def _(spark, d):
    return rounded(G.contributors(labelings(spark, d).where(F.col("seed") == 11), "cluster", ["label", "partition"]))
