"""Places of rows in one global order: a sample sort and a scan over the sizes of its partitions.

Rows are dealt into ranges of about equal size by sampled bounds, sorted there and written with their place in the range. The sum of all ranges before is added from a table with one
row per range. No task holds more than a range, whatever
the values look like (one prefix, one huge key), and the number of ranges follows the size of the data. Rows that are equal in the order share a range: make them
distinct, or add a column that tells them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import one_row
from .scratch import written


def _ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The sorted ranges, frozen: `_range` and `_place` in it."""
    at = F.monotonically_increasing_id()
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return written(cut, "ranges").select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_at")


def _shifted(rows: DataFrame, size: Column) -> DataFrame:
    """`_before`: sum of `size` over all earlier ranges."""
    sizes = rows.groupBy("_range").agg(size.alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # one row per range: as many as the shuffle has partitions
    return rows.join(F.broadcast(shift), F.col("_range") == F.col("_r")).drop("_r")


def positions(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the order; rows that are equal in it come one after the other in any order."""
    placed = _shifted(_ranges(df, order), F.count("*"))
    return placed.withColumn(out, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def sums_before(df: DataFrame, order: Sequence[Column | str], value: str, out: str = "before") -> DataFrame:
    """Adds the sum of `value` (a whole number) over all rows before this one in the order."""
    placed = _shifted(_ranges(df, order), F.sum(value))
    earlier = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("_range", "_place", "_before")


def value_steps(df: DataFrame, keys: Sequence[str], value: str, parts: Sequence[str] = ()) -> DataFrame:
    """Distinct finite values per key with their count, the number of smaller values (`below`) and the key's row count: (keys, value, parts, _c, c_all, below, n_key). With
    `parts`, _c counts a part's rows and c_all those of all parts. Rows shrink to distinct values before they are sorted; NULL keys are left out."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, *parts, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counts = rows.groupBy(*keys, *parts, "_x").agg(F.count("*").alias("_c"))
    values = counts.groupBy(*keys, "_x").agg(F.sum("_c").alias("c_all")) if parts else counts.withColumn("c_all", F.col("_c"))
    steps = sums_before(values, [*keys, "_x"], "c_all", "_sum")
    per = steps.groupBy(*keys).agg(F.min("_sum").alias("_start"), F.sum("c_all").alias("n_key"))
    if keys:
        steps = steps.join(per, list(keys))
    else:
        one = one_row(per)
        steps = steps.select("*", one["_start"].alias("_start"), one["n_key"].alias("n_key"))
    steps = steps.withColumn("below", F.col("_sum") - F.col("_start")).drop("_sum", "_start")
    if parts:
        steps = counts.join(steps, [*keys, "_x"])
    return steps.withColumnRenamed("_x", value)
