"""Anonymous codes for labels, by a seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import row_numbers


def blind_map(labels: DataFrame, column: str, seed: int, prefix: str = "R") -> DataFrame:
    """(label, code): distinct labels in the order of sha256("seed::label"), codes R01, R02, ..."""
    d = labels.select(F.col(column).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    d = d.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}::"), F.col("label")), 256))
    ranked = row_numbers(d, [], ["_h"], F.substring("_h", 1, 3), "_rn")
    return ranked.select("label", F.format_string(f"{prefix}%02d", F.col("_rn")).alias("code"))


def apply_blind_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The column replaced by its code; a label without a code fails the job."""
    m = mapping.select(F.col("label").alias("_l"), F.col("code").alias("_c"))
    j = df.join(m, F.col(column).cast("string") == F.col("_l"), "left")
    missing = F.raise_error(F.concat(F.lit("no blind code for "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    code = F.when(F.col("_c").isNull(), missing.cast("string")).otherwise(F.col("_c"))
    return j.withColumn(column, code).drop("_l", "_c")


def unblind(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Codes replaced by their labels."""
    inverse = mapping.select(F.col("code").alias("label"), F.col("label").alias("code"))
    return apply_blind_map(df, column, inverse)


def blinded_manifest(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Codes only."""
    return apply_blind_map(df.select(column), column, mapping)
