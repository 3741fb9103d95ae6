"""The held-out evaluation and the baseline dry run as one plan over operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import clustering as C
from ..operators import decisions as D
from ..operators import effects as X
from ..operators import probes as P
from ..operators.linear import fit_pca
from ..sources.sinks import report_rows


def held_out(
    rows: DataFrame, key: str, vec: str, models: dict[int, C.Centres], reference: int, features: Sequence[str], unit: str, context: str,
    partition: str = "partition", train: str = "train", test: str = "test", silhouette_rows: int | None = None,
) -> DataFrame:
    """Tidy (seed, metric, value) of the test rows: frozen assignment, alignment learnt on training
    rows, margin, occupancy, silhouette, identity and context association, feature effects, pairs."""
    seeds, k = list(models), next(iter(models.values())).k
    keep = [key, unit, context, partition, *features]
    lab = C.assign_many(rows, vec, models, [*keep, vec], margins=True)
    mapping = G.align_seeds(lab.where(F.col(partition) == train), key, "seed", "cluster", k, seeds, reference)
    te = G.apply_mapping(lab.where(F.col(partition) == test), mapping, ["seed", "cluster"])
    te = te.withColumn("label", F.coalesce("aligned", "cluster"))
    parts = [
        report_rows(te.groupBy("seed").agg(C.margin().alias("margin")), "held_out", ["seed"], ["margin"]),
        report_rows(C.occupancy(te, k, "label", ["seed"]), "held_out", ["seed"], ["min_cluster_fraction", "empty_clusters"]),
    ]
    for field, name in ((unit, "identity"), (context, "context")):
        ct = G.contingency(te, field, "label", ["seed"])
        m = G.measures(ct, field, "label", ["seed"]).join(G.cramers_v(ct, field, "label", ["seed"]).select("seed", "cramers_v"), "seed")
        named = m.select("seed", F.col("nmi").alias(f"{name}_nmi"), F.col("cramers_v").alias(f"{name}_v"))
        parts.append(report_rows(named, "held_out", ["seed"], [f"{name}_nmi", f"{name}_v"]))
    eff = X.effect_sizes(X.group_moments(te, "label", features, ["seed"]), ["seed"])
    parts.append(eff.select(F.lit("held_out").alias("analysis"), "seed", F.concat(F.lit("eta_"), F.col("feature")).alias("metric"), F.col("eta_squared").alias("value")))
    pairs = G.pairwise_agreement(G.by_seed(te, key, "seed", "label", seeds), seeds)
    parts.append(report_rows(pairs.select(F.col("seed_a").alias("seed"), F.col("ari").alias("cross_seed_ari"), F.col("agreement").alias("aligned_agreement")), "held_out", ["seed"], ["cross_seed_ari", "aligned_agreement"]))
    ref = te.where(F.col("seed") == reference)
    sil = C.silhouette(ref.select(key, vec, "label"), key, vec, "label", silhouette_rows, reference)
    parts.append(report_rows(sil.select(F.lit(reference).cast("bigint").alias("seed"), "silhouette"), "held_out", ["seed"], ["silhouette"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims(tidy: DataFrame, rules: Sequence[D.Claim], rename: dict[str, str] | None = None) -> DataFrame:
    """Claim statuses from tidy metrics; `rename` maps metric names to those the rules use."""
    t = tidy
    for old, new in (rename or {}).items():
        t = t.withColumn("metric", F.when(F.col("metric") == old, new).otherwise(F.col("metric")))
    used = sorted({b[0] for c in rules for b in (*c.supported, *(c.weakened or ()))})
    return D.assess(D.metric_row(t, used), rules)


def dry_run(
    rows: DataFrame, key: str, vec: str, features: Sequence[str], speed: str, context: str, components: int, k: int, seed: int,
    flags: Sequence[str] = (), partition: str = "partition", probe_iterations: int = 50,
) -> DataFrame:
    """Baseline before the real run: PCA and mixture on training rows, occupancy, confidence, speed
    effect, context probe and quality proxies on validation rows, tidy (metric, value)."""
    tr, va = rows.where(F.col(partition) == "train"), rows.where(F.col(partition) == "validation")
    pca = fit_pca(tr, vec, k=components)
    mix = C.fit_gmm(pca.project(tr, vec).select("pc"), "pc", k, seed)
    lab = C.predict_gmm(pca.project(va, vec), "pc", mix, [key, speed, context, *flags])
    eff = X.effect_sizes(X.group_moments(lab, "cluster", [speed])).select(F.col("eta_squared").alias("speed_eta"))
    probe = P.classification_scores(P.logistic_probe(tr, va, features, context, max_iter=probe_iterations))
    named = probe.select(*[F.col(c).alias(f"context_{c}") for c in ("accuracy", "balanced_accuracy", "macro_f1", "chance_ratio")])
    parts = [
        _tidy(C.occupancy(lab, k)),
        _tidy(lab.agg(F.avg("confidence").alias("confidence"), F.avg("log_lik").alias("log_lik"), *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in flags])),
        _tidy(eff), _tidy(named),
        _tidy(lab.agg(F.lit(mix.bic).alias("bic"), F.lit(mix.aic).alias("aic"), F.lit(float(sum(pca.ratios[:components]))).alias("explained"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tidy(one: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*cells)))
