"""Quality flags and acceptance, identifiers and labels, and expectation rules on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import as_col
from ..functions.expressions import ladder, ratio
from ..functions.ordering import quantiles
from ..sources.bouts import rule_rows
from .features import heading_change_deg, path_distance

# Acceptance limits of one bout and the speed above which a bout is flagged.
EXTREME_SPEED = 100.0
MIN_DURATION_S, MAX_DURATION_S = 0.04, 1.2
MIN_DISTANCE, MAX_DISTANCE = 0.0, 25.0
MIN_SPEED, MAX_SPEED = 1.0, 50.0
MAX_HEADING_CHANGE = 180.0


# ---- bout quality ------------------------------------------------------------------------------

def qc_flags(bouts: DataFrame, speed: str = "speed", others: Sequence[str] = ("heading",)) -> DataFrame:
    """Adds contains_nonfinite, all_zero_speed, extreme_speed, max_abs_speed, primary_exclude and
    sensitivity_flag."""
    bad = F.exists(speed, A.nonfinite)
    for c in others:
        bad = bad | F.exists(c, A.nonfinite)
    top = F.array_max(F.transform(F.filter(speed, lambda x: ~A.nonfinite(x)), lambda x: F.abs(x)))
    out = bouts.withColumns({
        "contains_nonfinite": bad, "all_zero_speed": F.forall(speed, lambda x: F.coalesce(x == 0, F.lit(False))), "max_abs_speed": top,
    })
    out = out.withColumn("extreme_speed", F.coalesce(F.col("max_abs_speed") > EXTREME_SPEED, F.lit(False)))
    return out.withColumns({
        "primary_exclude": F.col("contains_nonfinite"), "sensitivity_flag": F.col("all_zero_speed") | F.col("extreme_speed"),
    })


def accept(df: DataFrame, duration: str, distance: str, heading_change: str) -> DataFrame:
    """Adds `reasons` (all failed limits, in fixed order) and `accepted`; limits are strict, so a
    value equal to a limit passes."""
    t, s, h = F.col(duration), F.col(distance), F.col(heading_change)
    v = F.when(t > 0, s / F.nullif(t, F.lit(0.0))).otherwise(F.lit(float("inf")))
    checks = [
        (t < MIN_DURATION_S, "time_too_short"), (t > MAX_DURATION_S, "time_too_long"),
        (s > MAX_DISTANCE, "distance_too_large"), (s < MIN_DISTANCE, "distance_negative"),
        (v > MAX_SPEED, "speed_too_high"), (v < MIN_SPEED, "speed_too_low"),
        (F.abs(h) > MAX_HEADING_CHANGE, "heading_change_too_large"),
    ]
    reasons = F.filter(F.array(*[F.when(c, name) for c, name in checks]), lambda r: r.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def measure_bouts(bouts: DataFrame, fps: float, scale: float) -> DataFrame:
    """Duration, raw path distance and body-axis change of variable-length bouts, ready for `accept`."""
    return bouts.withColumns({
        "duration_s": F.size("x") / F.lit(fps), "distance": path_distance(F.col("x"), F.col("y"), scale),
        "heading_change": heading_change_deg(F.col("x"), F.col("y"), F.col("tail_x"), F.col("tail_y")),
    })


def reason_counts(accepted: DataFrame) -> DataFrame:
    return accepted.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def drop_units(bouts: DataFrame, units: DataFrame, keys: Sequence[str], label: str = "condition_label", bad: str = "bad_data") -> DataFrame:
    """Without every bout of a unit labelled bad."""
    return bouts.join(units.where(F.col(label) == bad).select(*keys).distinct(), list(keys), "left_anti")


def unit_counts(bouts: DataFrame, units: DataFrame, keys: Sequence[str], label: str = "condition_label", bad: str = "bad_data") -> DataFrame:
    """Units in all, bad units, units without a bout, bouts excluded with bad units."""
    per = bouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    u = units.select(*keys, (F.col(label) == bad).alias("_bad")).join(per, list(keys), "left")
    n = F.coalesce("_n", F.lit(0))
    return u.agg(
        F.count(F.lit(1)).alias("units"), F.count_if("_bad").alias("bad_units"), F.count_if(n == 0).alias("empty_units"),
        F.coalesce(F.sum(F.when(F.col("_bad"), n)), F.lit(0)).alias("excluded_bouts"),
    )


def funnel(rows: DataFrame, family: str, excluded: str = "excluded", accepted: str = "accepted") -> DataFrame:
    """Raw, excluded, candidate, accepted and rejected bouts per family and in all (family NULL)."""
    ex, ok = F.col(excluded), F.col(accepted)
    return rows.rollup(family).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(ex).alias("excluded"), F.count_if(~ex).alias("candidates"),
        F.count_if(~ex & ok).alias("accepted"), F.count_if(~ex & ~ok).alias("rejected"),
    )


def funnel_check(funnel_rows: DataFrame, expected: dict[str, int], family: str) -> DataFrame:
    """The overall funnel against frozen counts."""
    total = funnel_rows.where(F.col(family).isNull())
    return rule_rows(total, [(name, F.col(name), F.lit(v)) for name, v in expected.items()])


def heading_unit(bouts: DataFrame, heading: str = "heading", stride: int = 1) -> DataFrame:
    """Unit of the heading column from the 99th percentile of its size: one row (max_abs, p99_abs, unit)."""
    picked = F.filter(heading, lambda x, i: (i % stride) == 0) if stride > 1 else F.col(heading)
    v = bouts.select(F.explode(picked).alias("_h")).where(~A.nonfinite(F.col("_h"))).select(F.abs("_h").alias("_h"))
    q = quantiles(v, [], "_h", {"p99_abs": 0.99})
    p = F.col("p99_abs")
    unit = F.when(p <= 2 * A.PI + 0.25, "radians_likely").when(p <= 365.0, "degrees_likely").otherwise("unknown")
    return q.select(v.agg(F.max("_h")).scalar().alias("max_abs"), "p99_abs", unit.alias("unit"))


def computability(bouts: DataFrame, previous_end: str | None = None, start: str = "start") -> DataFrame:
    """Which feature groups each bout allows: timing and speed need two clean samples, speed change
    three, turning two headings, the interval a predecessor. Adds can_* flags and `input_reason`."""
    n = F.least(F.size("x"), F.size("y"), F.size("heading"))
    dirty = F.exists("x", A.nonfinite) | F.exists("y", A.nonfinite) | F.exists("heading", A.nonfinite)
    base = (n >= 2) & ~dirty
    gap = (F.col(previous_end).isNotNull() & F.col(start).isNotNull()) if previous_end else F.lit(False)
    return bouts.withColumns({
        "n_samples": n, "can_bout_duration": base, "can_speed": base, "can_speed_change": base & (n >= 3), "can_turning": base,
        "can_inter_bout_interval": base & gap, "input_reason": F.when(n < 2, "too_short").when(dirty, "nonfinite_source"),
    })


def computability_report(flags: DataFrame) -> DataFrame:
    """(feature, yes, no, fraction) for every can_* flag."""
    names = [c for c in flags.columns if c.startswith("can_")]
    agg = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in names])
    cells = [F.struct(F.lit(c[4:]).alias("feature"), F.col(c).alias("yes"), (F.col("n") - F.col(c)).alias("no"), ratio(F.col(c), F.col("n")).alias("fraction")) for c in names]
    return agg.select(F.inline(F.array(*cells)))


def proxy_rates(rows: DataFrame, flags: Sequence[str], by: Sequence[str] = ("partition",)) -> DataFrame:
    """Mean of each boolean flag per group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def artefact_enrichment(rows: DataFrame, flags: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, proxy, n, rate, overall, enrichment): rate of each proxy in a cluster over its overall
    rate. Nothing is dropped. The overall rate is rebuilt from the cluster rows."""
    g = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f) for f in flags])
    long = g.unpivot([F.col(cluster), F.col("n")], [F.col(f) for f in flags], "proxy", "hits")
    overall = long.groupBy("proxy").agg(ratio(F.sum("hits"), F.sum("n")).alias("overall"))
    rate = ratio(F.col("hits"), F.col("n"))
    return long.join(overall, "proxy").select(
        cluster, "proxy", "n", rate.alias("rate"), "overall", (rate / F.nullif(F.col("overall"), F.lit(0.0))).alias("enrichment")
    )


# ---- identifiers and labels --------------------------------------------------------------------

def unit_id(dataset: str, recording: Column | str, well: Column | str) -> Column:
    return F.format_string("%s::%s::well%02d", F.lit(dataset), as_col(recording), as_col(well).cast("bigint"))


def bout_id(dataset: str, recording: Column | str, well: Column | str, bout: Column | str) -> Column:
    return F.format_string(
        "%s::%s::well%02d::bout%06d", F.lit(dataset), as_col(recording), as_col(well).cast("bigint"), as_col(bout).cast("bigint")
    )


def family(recording: Column | str, names: Sequence[str], otherwise: str = "UNKNOWN") -> Column:
    """First of the names that occurs in the recording id."""
    out = None
    for n in names:
        c = as_col(recording).contains(n)
        out = F.when(c, n) if out is None else out.when(c, n)
    return out.otherwise(otherwise)


# The thirteen conventional classes by code.
KNOWN_CLASSES = [
    "Short_CS", "Long_CS", "BS", "O_bend", "J_turn", "SLC", "Slow1", "RT", "Slow2", "LLC", "AS", "SAT", "HAT",
]


def known_label(raw: Column | str, classes: Sequence[str] = tuple(KNOWN_CLASSES), missing: str = "__MISSING__") -> Column:
    """Class name of a raw label: names stay, "4" or "4.0" index the list from 0 (the value just past
    the end counts from 1), blanks become the missing mark, anything else is kept as it is."""
    v = F.trim(as_col(raw).cast("string"))
    names = F.array(*[F.lit(c) for c in classes])
    num = v.try_cast("double")
    whole = F.when(num.isNotNull() & ~F.isnan(num) & (F.abs(num) < 1e9), F.floor(num)).cast("int")
    exact = F.abs(num - whole) <= 1e-9 * F.greatest(F.abs(num), F.abs(whole.cast("double")))
    top = len(classes)
    by_zero = F.element_at(names, F.when(whole.between(0, top - 1), whole + 1).otherwise(F.lit(1)))
    return (
        F.when(v.isNull() | (v == ""), missing)
        .when(v.isin(*classes), v)
        .when(exact & whole.between(0, top - 1), by_zero)
        .when(exact & (whole == top), classes[-1])
        .otherwise(v)
    )


def partition_name(raw: Column | str, allowed: Sequence[str] = ("train", "validation", "test")) -> Column:
    """Trimmed lower-case partition name, NULL when it is not an allowed one."""
    v = F.lower(F.trim(as_col(raw)))
    return F.when(v.isin(*allowed), v)


def audit_metadata(bouts: DataFrame, ids: Sequence[str], hz: float, speed: str = "speed") -> DataFrame:
    """Audit row per bout: times in seconds, signed speed mean, std, max, rms and the quality flags."""
    staged = qc_flags(bouts, speed).withColumn("_m", A.moments(F.col(speed)))
    m = F.col("_m")
    return staged.select(
        *ids, (F.col("start") / hz).alias("start_s"), (F.col("end") / hz).alias("end_s"), A.m_mean(m).alias("speed_mean"),
        A.m_std(m).alias("speed_std"), m["top"].alias("speed_max"), A.m_rms(m).alias("speed_rms"), "all_zero_speed", "extreme_speed",
    )


def encode_categories(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes 0.. by sorted order of the distinct values; NULL has none. The values are sorted in ranges of equal size, whatever their prefixes."""
    from ..functions.positions import positions

    name = F.col(column).cast("string")
    coded = positions(df.select(column).where(F.col(column).isNotNull()).distinct(), [name], out)
    return df.join(coded.select(column, out), column, "left")


def ari_band(c: Column) -> Column:
    return ladder(c, [(0.75, "strong"), (0.50, "moderate"), (0.25, "weak")], "poor")


def r2_band(c: Column) -> Column:
    return ladder(c, [(0.75, "very_high"), (0.50, "high"), (0.25, "moderate")], "low")


def direction(value: Column, threshold: float = 0.10) -> Column:
    return F.when(value > threshold, "positive").when(value < -threshold, "negative").when(value.isNotNull(), "neutral")


# ---- expectation rules -------------------------------------------------------------------------

def dataset_rules(fish: DataFrame, bouts: DataFrame, expected: dict[str, int], key: str = "fish_id", count: str = "valid_bouts", context: str = "context_name") -> DataFrame:
    """Unit, bout and context counts, unique units, no negative count, contiguous bout indices and the
    declared count of every unit: rows (rule, observed, expected, passed)."""
    units = fish.agg(
        F.count(F.lit(1)).alias("units"), F.countDistinct(key).alias("distinct_units"), F.countDistinct(context).alias("contexts"),
        F.count_if(F.col(count) < 0).alias("negative_counts"), F.sum(count).alias("declared_bouts"),
    )
    per = bouts.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("bout_index").alias("_d"), F.min("bout_index").alias("_lo"), F.max("bout_index").alias("_hi")
    )
    j = fish.select(key, count).join(per, key, "full_outer")
    n = F.coalesce("_n", F.lit(0))
    seen = j.agg(
        F.sum(n).alias("bouts"), F.count_if(~F.col(count).eqNullSafe(n)).alias("count_mismatch"),
        F.count_if((n > 0) & ((F.col("_lo") != 0) | (F.col("_hi") != F.col("_n") - 1) | (F.col("_d") != F.col("_n")))).alias("index_gaps"),
    )
    z = F.lit(0)
    a = rule_rows(units, [
        ("unit_count", F.col("units"), F.lit(expected["units"])), ("context_count", F.col("contexts"), F.lit(expected["contexts"])),
        ("units_unique", F.col("distinct_units"), F.col("units")), ("no_negative_count", F.col("negative_counts"), z),
        ("declared_bouts", F.col("declared_bouts"), F.lit(expected["bouts"])),
    ])
    b = rule_rows(seen, [
        ("bout_count", F.col("bouts"), F.lit(expected["bouts"])), ("count_matches_declared", F.col("count_mismatch"), z),
        ("bout_index_contiguous", F.col("index_gaps"), z),
    ])
    return a.unionByName(b)


def split_overlap(df: DataFrame, unit: str, partition: str = "partition") -> DataFrame:
    """Units that occur in more than one partition."""
    g = df.groupBy(unit).agg(F.countDistinct(partition).alias("partitions"))
    return g.where(F.col("partitions") > 1)


def missing_contexts(df: DataFrame, context: str, partitions: Sequence[str], partition: str = "partition") -> DataFrame:
    """(context, partition) combinations that do not occur."""
    g = df.groupBy(context).agg(F.array(*[F.max((F.col(partition) == p).cast("int")) for p in partitions]).alias("_seen"))
    names = F.array(*[F.lit(p) for p in partitions])
    return g.select(context, F.explode(F.filter(names, lambda p, i: F.element_at("_seen", i + 1) == 0)).alias("missing_partition"))


def feature_audit(df: DataFrame, features: Sequence[str], unit: str, flags: Sequence[str] = (), partition: str = "partition") -> DataFrame:
    """Rows, non-finite cells, units and flag counts per partition (NULL = all)."""
    bad = sum((F.count_if(A.nonfinite(F.col(f))) for f in features[1:]), F.count_if(A.nonfinite(F.col(features[0]))))
    return df.rollup(partition).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("features"), bad.alias("nonfinite_cells"),
        F.countDistinct(unit).alias("units"), *[F.count_if(f).alias(f) for f in flags],
    )


def scaling_audit(scaled: DataFrame, features: Sequence[str], tolerance: float = 1e-4, partition: str = "partition", train: str = "train") -> DataFrame:
    """(feature, mean, std, passed) on the training rows; a feature without spread keeps std 0."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f"_{i}") for i, f in enumerate(features)]
    out = scaled.where(F.col(partition) == train).agg(*aggs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    ok = (F.abs("mean") <= tolerance) & ((F.abs(F.col("std") - 1) <= tolerance) | (F.col("std") <= tolerance))
    return out.withColumn("passed", ok)


def metadata_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the metadata that only one side has, counted with repeats: (side, columns)."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def embedding_rules(df: DataFrame, key: str, vec: str, dim: int, index: str | None = None, variance_floor: float = 1e-8, expected_rows: int | None = None, single: Sequence[str] = ()) -> DataFrame:
    """Shape, finiteness, unique ids, contiguous index, collapsed dimensions, zero norms: rule rows.
    Dimension variances are plain aggregates, nothing is exploded."""
    e = lambda i: F.col(vec)[i].cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(vec) != dim).alias("bad_shape"), F.count_if(F.exists(vec, A.nonfinite)).alias("nonfinite"),
        F.countDistinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("null_ids"), F.count_if(A.norm(F.col(vec)) == 0).alias("zero_norm"),
        F.array(*[F.var_pop(e(i)) for i in range(dim)]).alias("_var"), *[F.countDistinct(c).alias(f"one_{c}") for c in single],
    ]
    if index:
        aggs += [F.min(index).alias("lo"), F.max(index).alias("hi"), F.countDistinct(index).alias("di")]
    agg = df.agg(*aggs).withColumn("collapsed", F.size(F.filter("_var", lambda v: v <= variance_floor)))
    z, n = F.lit(0), F.col("n")
    rules = [
        ("shape", F.col("bad_shape"), z), ("finite", F.col("nonfinite"), z), ("ids_unique", F.col("ids"), n), ("ids_not_null", F.col("null_ids"), z),
        ("no_zero_norm", F.col("zero_norm"), z), ("no_collapsed_dimension", F.col("collapsed"), z),
    ]
    rules += [(f"single_{c}", F.col(f"one_{c}"), F.lit(1)) for c in single]
    if index:
        rules += [("index_from_zero", F.col("lo"), z), ("index_contiguous", F.col("hi") + 1, n), ("index_unique", F.col("di"), n)]
    if expected_rows is not None:
        rules.append(("row_count", n, F.lit(expected_rows)))
    return rule_rows(agg, rules)


def alignment_mismatches(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Key-wise comparison of two representations of the same rows: counts of rows only on one side,
    repeated keys and unequal fields, one row (check, n) each."""
    x = a.groupBy(*key).agg(F.count(F.lit(1)).alias("_na"), *[F.min(f).alias(f"_a_{f}") for f in fields])
    y = b.groupBy(*key).agg(F.count(F.lit(1)).alias("_nb"), *[F.min(f).alias(f"_b_{f}") for f in fields])
    both = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    agg = x.join(y, list(key), "full_outer").agg(
        F.count_if(F.col("_nb").isNull()).alias("only_left"), F.count_if(F.col("_na").isNull()).alias("only_right"),
        F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("repeated_key"),
        *[F.count_if(both & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))).alias(f"unequal_{f}") for f in fields],
    )
    names = ["only_left", "only_right", "repeated_key", *[f"unequal_{f}" for f in fields]]
    return agg.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in names])))


def lookup(rows: DataFrame, values: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Checked 1:1 join onto label rows: the joined rows, and the problems (key, problem) where the key
    is missing from `values` or used by several rows of either side."""
    right = values.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in values.columns if c != key])
    joined = rows.join(right.where(F.col("_n") == 1).drop("_n"), key)
    used = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_used"))
    state = used.join(right.select(key, "_n"), key, "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("_used") > 1, "reused")
    return joined, state.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def unseen_classes(train: DataFrame, held: DataFrame, label: str) -> DataFrame:
    """Classes of the evaluation rows that training does not have."""
    return held.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")
