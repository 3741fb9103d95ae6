"""Predictability probes and their scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .agreement import contingency
from .linear import column_means, gram, vector_of
from .sampling import class_holdout, subsample
from .scaling import apply_scaler, fit_medians, fit_scaler, impute

# ---- scores ------------------------------------------------------------------------------------


def classification_scores(pred: DataFrame, truth: str = "truth", guess: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over classes in the truth), macro F1 (over the union of
    labels, undefined -> 0), majority rate, uniform chance and accuracy over chance, from the confusion table."""
    ct = contingency(pred.select(*by, F.col(truth).cast("string").alias("_t"), F.col(guess).cast("string").alias("_g")), "_t", "_g", by)
    hit = F.sum(F.when(F.col("_t") == F.col("_g"), F.col("n")).otherwise(0))
    t = ct.groupBy(*by, F.col("_t").alias("_l")).agg(F.sum("n").alias("nt"), hit.alias("tp"))
    g = ct.groupBy(*by, F.col("_g").alias("_l")).agg(F.sum("n").alias("np"))
    # a label that is missing is a label of its own, so both sides are stacked, not joined
    both = t.withColumn("np", F.lit(0).cast("long")).unionByName(g.withColumns({"nt": F.lit(0).cast("long"), "tp": F.lit(0).cast("long")}))
    j = both.groupBy(*by, "_l").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
    tp, nt = F.col("tp"), F.col("nt")
    out = j.groupBy(*by).agg(
        F.sum("nt").alias("n"), (F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg(F.when(nt > 0, tp / F.nullif(nt, F.lit(0)))).alias("balanced_accuracy"),
        F.avg(2.0 * tp / (nt + F.col("np"))).alias("macro_f1"), (F.max("nt") / F.sum("nt")).alias("majority"),
        (1.0 / F.count_if(nt > 0)).alias("chance"),
    )
    return out.withColumn("chance_ratio", F.col("balanced_accuracy") / F.col("chance"))


def regression_scores(pred: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """R2 and mean absolute error."""
    e = F.col(truth) - F.col(guess)
    g = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), (F.var_pop(truth) * F.count(truth)).alias("_sst"), F.avg(F.abs(e)).alias("mae")
    )
    return g.select(*by, "n", (1.0 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("r2"), "mae")


# ---- classifiers -------------------------------------------------------------------------------


def _prepare(train: DataFrame, held: DataFrame, features: Sequence[str], label: str, standardize: bool, fill: bool) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """The cached training base, both sides with `_x` (and `_y` in training), and the class names in code order. The classes are
    held by the model itself, so their list is bounded by what can be fitted at all."""
    if fill:
        med = fit_medians(train, features)
        train, held = impute(train, features, med), impute(held, features, med)
    if standardize:
        p = fit_scaler(train, features)
        train, held = apply_scaler(train, features, p), apply_scaler(held, features, p)
    v = array_to_vector(vector_of(features)).alias("_x")
    data = train.select(F.col(label).cast("string").alias("_label"), v).persist()
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(data)
    return data, index.transform(data), held.select(F.col(label).cast("string").alias("truth"), v), list(index.labels)


def _answers(model, held: DataFrame, names: list[str]) -> DataFrame:
    pred = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int"))
    return model.transform(held).select("truth", pred.alias("pred"))


def logistic_probe(
    train: DataFrame, held: DataFrame, features: Sequence[str], label: str, balanced: bool = True, c: float = 1.0,
    standardize: bool = True, max_iter: int = 100, fill: bool = False,
) -> DataFrame:
    """Multinomial logistic probe fitted on training rows: (truth, pred) of the held-out rows. The
    penalty is per row sum, so it becomes 1/(c n); classes weigh n/(classes * class rows) if balanced.
    `fill` puts training medians in place of missing values."""
    base, data, rows, names = _prepare(train, held, features, label, standardize, fill)
    counts = {int(r[0]): r[1] for r in data.groupBy("_y").count().collect()}
    n, k = sum(counts.values()), len(names)
    weights = F.array(*[F.lit(n / (k * counts[i]) if balanced else 1.0) for i in range(k)])
    lr = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, family="multinomial"
    )
    model = lr.fit(data.withColumn("_w", F.element_at(weights, (F.col("_y") + 1).cast("int"))))
    base.unpersist()
    return _answers(model, rows, names)


def boosted_probe(train: DataFrame, held: DataFrame, features: Sequence[str], label: str, **settings) -> DataFrame:
    """Boosted trees over all classes at once (settings as in `boosting.fit`; the defaults are the study's): (truth, pred) of the held-out rows."""
    model = boosting.fit(train, features, label, **settings)
    rows = held.select(F.col(label).cast("string").alias("truth"), *[F.col(f) for f in features if f != "truth"])
    return boosting.predict(rows, model, ["truth"])


def forest_probe(
    train: DataFrame, held: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4, seed: int = 0, min_leaf: int = 1,
) -> DataFrame:
    """Random forest, the cheaper tree probe: (truth, pred)."""
    base, data, rows, names = _prepare(train, held, features, label, False, True)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=min_leaf).fit(data)
    base.unpersist()
    return _answers(model, rows, names)


def holdout_probe(rows: DataFrame, key: str, label: str, features: Sequence[str], seed: int, min_rows: int = 4, **kw) -> DataFrame:
    """Identity or context probe: classes with enough rows, 80/20 inside each class, scores of the
    held-out part."""
    cut = class_holdout(rows, key, label, seed, min_rows=min_rows)
    pred = logistic_probe(cut.where(~F.col("held_out")), cut.where("held_out"), features, label, **kw)
    return classification_scores(pred)


def recoverability(rows: DataFrame, key: str, features: Sequence[str], label: str, max_rows: int, seed: int, min_rows: int = 4, **kw) -> DataFrame:
    """How well one representation's features give the other's labels: at most max_rows rows train, all held-out rows are scored."""
    cut = class_holdout(rows, key, label, seed, min_rows=min_rows)
    train = subsample(cut.where(~F.col("held_out")), key, max_rows, seed)
    return classification_scores(logistic_probe(train, cut.where("held_out"), features, label, **kw))


# ---- ridge -------------------------------------------------------------------------------------


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ridge regression with an unpenalised intercept. The centred
    cross-product matrix is summed on the executors; a (d+1) x (d+1) block reaches the driver."""
    d = len(features)
    data = train.select(vector_of([*features, target]).alias("_v"))
    mu = column_means(data, "_v", d + 1)
    m = np.zeros((d + 1, d + 1))
    for r in gram(data, "_v", d + 1, mu).collect():
        m[r["i"]] = r["row"]
    beta = np.linalg.solve(m[:d, :d] + alpha * np.eye(d), m[:d, d])
    return beta, float(mu[d] - mu[:d] @ beta)


def predict_linear(df: DataFrame, features: Sequence[str], beta: np.ndarray, intercept: float, out: str = "pred") -> DataFrame:
    terms = [F.col(f) * float(b) for f, b in zip(features, beta)]
    return df.withColumn(out, sum(terms, F.lit(float(intercept))))


def ridge_probe(train: DataFrame, held: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, standardize: bool = True) -> DataFrame:
    """R2 and MAE on held-out rows."""
    if standardize:
        p = fit_scaler(train, features)
        train, held = apply_scaler(train, features, p), apply_scaler(held, features, p)
    beta, b0 = fit_ridge(train, features, target, alpha)
    return regression_scores(predict_linear(held, features, beta, b0), target, "pred")


def scores_table(scores: dict[str, DataFrame]) -> DataFrame:
    """Named score rows under each other."""
    out = None
    for name, df in scores.items():
        one = df.select(F.lit(name).alias("probe"), "*")
        out = one if out is None else out.unionByName(one)
    return out
