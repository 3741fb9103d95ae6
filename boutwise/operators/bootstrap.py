"""Bootstrap over units. A replicate is a weight per unit; rows are never copied."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.ordering import row_numbers
from . import manyfits as M
from .agreement import contingency, measures
from .assignment import best_assignment
from .clustering import Centres


DRAWS = 1 << 20  # counted by one task before they are shuffled


def unit_weights(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """(rep, unit, weight): each replicate draws as many units as there are, with replacement. Draw i
    of replicate r picks unit md5(seed, r, i) mod n in a fixed hash order of units; the draws are made by the unit rows
    themselves, then counted with map-side combination. Units are few bytes and many draws, so they are dealt to tasks by the number of draws."""
    d = units.select(unit).distinct()
    numbered = _numbered(d, unit)
    n = d.count()
    dealt = numbered.select("_i").repartition(max(1, -(-n * replicates // DRAWS)), "_i")
    slots = dealt.select("_i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = slots.select(F.col("rep").cast("bigint").alias("rep"), F.pmod(H.draw(seed, "rep", "_i"), F.lit(n).cast("bigint")).alias("_i"))
    counts = drawn.groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(numbered, "_i").select("rep", unit, "weight")


def _numbered(d: DataFrame, unit: str) -> DataFrame:
    """0-based index `_i` in a fixed hash order of the units."""
    h = d.withColumn("_h", H.digest("unit", unit))
    return row_numbers(h, [], ["_h", unit], H.bucket(F.col("_h")), "_rn").select(unit, (F.col("_rn") - 1).alias("_i"))


def expand(rows: DataFrame, weights: DataFrame, unit: str) -> DataFrame:
    """Rows of the drawn units with their weight (a unit drawn twice counts twice)."""
    return rows.join(weights, unit)


def replicate_statistic(per_unit: DataFrame, weights: DataFrame, unit: str, statistic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any statistic per replicate. `per_unit` holds pre-aggregated unit rows; `statistic` turns
    (rep, weight, unit columns) into (rep, value)."""
    return statistic(expand(per_unit, weights, unit))


def interval(values: DataFrame, value: str = "value", confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval with median and quartiles over the replicates (their number is a parameter)."""
    a = (1.0 - confidence) / 2.0
    q = F.percentile(value, F.array(*[F.lit(p) for p in (a, 0.25, 0.5, 0.75, 1.0 - a)]))
    g = values.groupBy(*by).agg(F.count(value).alias("replicates"), q.alias("_q"))
    names = ["low", "q25", "median", "q75", "high"]
    return g.select(*by, "replicates", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def bootstrap(
    rows: DataFrame, unit: str, pre: Callable[[DataFrame], DataFrame], statistic: Callable[[DataFrame], DataFrame],
    replicates: int, seed: int, confidence: float = 0.95,
) -> DataFrame:
    """Point value, median, quartiles and percentile interval of a statistic over units. `pre` reduces
    rows to a few per unit; the point value gives every unit weight one."""
    per_unit = pre(rows)
    w = unit_weights(rows, unit, replicates, seed)
    reps = replicate_statistic(per_unit, w, unit, statistic)
    point = statistic(per_unit.withColumns({"rep": F.lit(-1).cast("bigint"), "weight": F.lit(1).cast("bigint")})).select("value").scalar()
    return interval(reps, confidence=confidence).select(point.alias("point"), "*")


def bootstrap_ari(rows: DataFrame, unit: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """ARI of two labelings per replicate: (rep, value), from per-unit contingency cells times weights."""
    cells = contingency(rows, a, b, [unit])
    w = unit_weights(rows, unit, replicates, seed)
    weighted = cells.join(w, unit).groupBy("rep", a, b).agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    return measures(weighted, a, b, ["rep"]).select("rep", F.col("ari").alias("value"))


def bootstrap_refit(
    train: DataFrame, held: DataFrame, unit: str, key: str, vec: str, reference: Centres, replicates: int, seed: int, max_iter: int = 20
) -> DataFrame:
    """Refit on resampled training units, label the fixed held-out rows, align to the reference labels and compare: (rep, rows, ari, agreement) per replicate, `rows` being
    the training rows by weight. All replicates are fitted in shared scans: a row carries the weights of its unit, one a replicate."""
    by_rep = F.collect_list(F.struct("rep", "weight"))
    found = F.map_from_entries(by_rep)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("double"))
    arrays = unit_weights(train, unit, replicates, seed).groupBy(unit).agg(found.alias("_m")).select(unit, every.alias("_w"))
    # a unit that no replicate drew takes no part
    data = M.prepared(train.select(unit, key, vec).join(arrays, unit), key, vec, "_w").persist()
    try:
        fits = [M.Fit(reference.k, seed + r, r) for r in range(replicates)]
        models = M.kmeans(data, fits, max_iter)
        _, counts, _ = M.moments(data, reference.values.shape[1], fits, [m.values for m in models])
    finally:
        data.unpersist()
    tables = M.crossings(M.prepared(held, key, vec), [(reference, m) for m in models])
    out = []
    for r, (t, n) in enumerate(zip(tables, counts, strict=True)):
        square = np.zeros((reference.k, reference.k), np.int64)
        square[:, :t.shape[1]] = t
        match = best_assignment(square)
        same = sum(int(square[i, j]) for i, j in enumerate(match))
        out.append((r, int(n.sum()), M.adjusted_rand(t), same / max(1, int(t.sum()))))
    return train.sparkSession.createDataFrame(out, "rep long, rows long, ari double, agreement double")
