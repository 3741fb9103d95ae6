"""Readers: unit records, bout scans, key tables, lookups and nested recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.ordering import row_numbers

FISH_SCHEMA = (
    "dataset_id string, cohort string, fish_id string, fish_index int, "
    "valid_bouts double, context_id string, context_name string"
)
SPLIT_SCHEMA = (
    "dataset_id string, fish_id string, fish_index int, context_id string, context_name string, "
    "partition string, split_seed bigint, split_version string"
)
CONDITION_SCHEMA = "recording_id string, well int, condition_code int, condition_label string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header that must carry the schema's columns in order; a bad row is an error."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def read_fish_master(spark: SparkSession, path: str) -> DataFrame:
    """The per-fish table; counts written as "12.0" are read as 12."""
    return read_csv(spark, path, FISH_SCHEMA).withColumn("valid_bouts", F.col("valid_bouts").cast("int"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SPLIT_SCHEMA)


def read_condition_map(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CONDITION_SCHEMA)


def fish_records(master: DataFrame, split: DataFrame, key: str = "fish_id", agree: Sequence[str] = ("context_name",)) -> DataFrame:
    """Master joined 1:1 with the frozen split. `problem` is NULL on good rows and else names the
    first broken rule: duplicate, missing_split, missing_master, disagree."""
    m = master.groupBy(key).agg(
        F.count(F.lit(1)).alias("_nm"), *[F.min(c).alias(c) for c in master.columns if c != key]
    )
    s = split.groupBy(key).agg(
        F.count(F.lit(1)).alias("_ns"), F.min("partition").alias("partition"),
        *[F.min(c).alias(f"_s_{c}") for c in agree],
    )
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    problem = (
        F.when(F.col("_ns").isNull(), "missing_split")
        .when(F.col("_nm").isNull(), "missing_master")
        .when((F.col("_nm") > 1) | (F.col("_ns") > 1), "duplicate")
        .when(differs, "disagree")
    )
    joined = m.join(s, key, "full_outer").withColumn("problem", problem)
    return joined.drop("_nm", "_ns", *[f"_s_{c}" for c in agree])


def require_clean(records: DataFrame, problem: str = "problem") -> DataFrame:
    """Fails the job on the first row that carries a problem; else the rows without that column."""
    ok = F.when(F.col(problem).isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("bad record: "), F.col(problem))).cast("boolean")
    )
    return records.where(ok).drop(problem)


def cut_bouts(samples: DataFrame, key: str, order: Sequence[str], slot: Column, length: int, fields: Sequence[str]) -> DataFrame:
    """Consecutive runs of `length` samples per key as one row with array columns. `slot` is a coarse
    monotone function of the order (a day), which spreads a very long key over many tasks."""
    numbered = row_numbers(samples, [key], list(order), slot, out="_n")
    picked = numbered.withColumn("bout_index", F.floor((F.col("_n") - 1) / length).cast("bigint"))
    # at most `length` samples per group
    runs = picked.groupBy(key, "bout_index").agg(
        F.sort_array(F.collect_list(F.struct("_n", *fields))).alias("_run")
    )
    return runs.select(key, "bout_index", *[F.col(f"_run.{f}").alias(f) for f in fields])


def whole_bouts(samples: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All samples of a key as one row with array columns, whatever their number; `bout_index` is 0."""
    runs = samples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_run"))
    return runs.select(key, F.lit(0).cast("bigint").alias("bout_index"), *[F.col(f"_run.{f}").alias(f) for f in fields])


def scan_bouts(
    bouts: DataFrame,
    fish: DataFrame | None = None,
    partition: str | None = None,
    context: str | None = None,
    qc: Column | None = None,
    fields: Sequence[str] | None = None,
    key: str = "fish_id",
) -> DataFrame:
    """Bouts of the chosen units. Conditions on plain columns come first so that they reach the scan
    and prune partitions; the unit filter is a semi join; arrays are read for surviving rows."""
    out = bouts
    if partition is not None:
        out = out.where(F.col("partition") == partition)
    if context is not None:
        out = out.where(F.col("context_name") == context)
    if fish is not None:
        out = out.join(fish.select(key), key, "left_semi")
    if qc is not None:
        out = out.where(qc)
    return out.select(*fields) if fields else out


def fish_field(bouts: DataFrame, fish: DataFrame, field: str, key: str = "fish_id", count: str = "valid_bouts") -> DataFrame:
    """One field of the valid bouts only: rows whose index lies below the unit's declared count."""
    return (
        bouts.select(key, "bout_index", field)
        .join(fish.select(key, count), key)
        .where(F.col("bout_index") < F.col(count))
        .select(key, "bout_index", field)
    )


def bout_keys(fish: DataFrame, key: str = "fish_id", count: str = "valid_bouts", block: int = 65536) -> DataFrame:
    """All valid bout keys from per-unit counts, without the bout table. Counts are expanded in two
    steps with a shuffle between, so that one very long unit is written by many tasks."""
    extra = [c for c in fish.columns if c not in (key, count)]
    n = F.col(count).cast("bigint")
    blocks = fish.where(n > 0).select(
        key, *extra, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block))).alias("_b")
    ).repartition(key, "_b")
    last = F.least(F.col("_n"), (F.col("_b") + 1) * block) - 1
    return blocks.select(
        key, *extra, F.explode(F.sequence(F.col("_b") * block, last)).alias("bout_index")
    )


def attach_conditions(rows: DataFrame, conditions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lookup of the condition per key; rows without one keep NULL and `condition_missing` is true.
    The lookup may be repeated over its keys: the last code given (largest) is kept."""
    lookup = conditions.groupBy(*keys).agg(
        F.max(F.struct("condition_code", "condition_label")).alias("_c")
    )
    return rows.join(lookup, list(keys), "left").select(
        *rows.columns, F.col("_c.condition_code").alias("condition_code"),
        F.col("_c.condition_label").alias("condition_label"), F.col("_c").isNull().alias("condition_missing"),
    )


def flatten_recordings(recordings: DataFrame, recording: str = "recording_id", wells: str = "wells") -> DataFrame:
    """wells: array<array<struct>> -> one row per bout, wells numbered from 1 and bouts from 0."""
    per_well = recordings.select(recording, F.posexplode(wells).alias("_w", "_bouts"))
    per_bout = per_well.select(recording, (F.col("_w") + 1).alias("well"), F.posexplode("_bouts").alias("bout_index", "_bout"))
    return per_bout.select(recording, "well", "bout_index", "_bout.*")


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing numbers become NULL, which aggregates skip."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def source_rules(rows: DataFrame, key: str, index: str, partition: str, seed: str, expected: int | None = None) -> DataFrame:
    """Checks of a per-seed metadata source, one row per rule: contiguous row index from 0, one
    partition, one seed, non-empty ids, unique ids, expected row count."""
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"),
        F.countDistinct(index).alias("distinct_index"), F.countDistinct(partition).alias("partitions"),
        F.countDistinct(seed).alias("seeds"),
        F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).alias("empty_ids"),
        F.countDistinct(key).alias("distinct_ids"),
    )
    n = F.col("n")
    rules = [
        ("row_index_from_zero", F.col("lo"), F.lit(0)),
        ("row_index_contiguous", F.col("hi") + 1, n),
        ("row_index_unique", F.col("distinct_index"), n),
        ("single_partition", F.col("partitions"), F.lit(1)),
        ("single_seed", F.col("seeds"), F.lit(1)),
        ("ids_not_empty", F.col("empty_ids"), F.lit(0)),
        ("ids_unique", F.col("distinct_ids"), n),
    ]
    if expected is not None:
        rules.append(("row_count", n, F.lit(expected)))
    return rule_rows(agg, rules)


def rule_rows(agg: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One aggregate row turned into (rule, observed, expected, passed) rows."""
    structs = [
        F.struct(
            F.lit(name).alias("rule"), got.cast("double").alias("observed"), want.cast("double").alias("expected")
        )
        for name, got, want in rules
    ]
    out = agg.select(F.inline(F.array(*structs)))
    return out.withColumn("passed", F.col("observed").eqNullSafe(F.col("expected")))


def primary_clean(speed: str = "speed", heading: str = "heading") -> Column:
    """Primary quality filter: no missing or non-finite sample."""
    return ~(F.exists(speed, A.nonfinite) | F.exists(heading, A.nonfinite))
