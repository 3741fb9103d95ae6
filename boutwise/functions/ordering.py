"""Rankings, neighbours and exact quantiles that never put a whole key into one task.

Every function splits a key into ordered buckets, works inside (key, bucket) and carries the
little that must cross a bucket edge through a table with one row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import one_row


def _before(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str = "rn", max_rows: int = 1_000_000
) -> DataFrame:
    """1-based row number per key. A key of more than max_rows rows is split by `bucket`, which must not
    decrease along `order` (a time slot, a digest prefix); other keys stay whole. Without keys the
    whole table is split. Keys must not be NULL."""
    if keys:
        # at most rows / max_rows keys can be this large
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)
        b = df.join(F.broadcast(large), list(keys), "left").withColumn("_bucket", F.when(F.col("_rows").isNotNull(), bucket)).drop("_rows")
        split = b.where(F.col("_bucket").isNotNull())
    else:
        b = split = df.withColumn("_bucket", bucket)
    sizes = split.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(_before(keys, "_bucket")), F.lit(0)).alias("_offset")
    )
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return (
        local.join(offsets, [*keys, "_bucket"], "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
        .drop("_bucket", "_local", "_offset")
    )


def first_rows(df: DataFrame, order: Column, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the smallest digest `order`, ranked bucket by bucket on the executors; buckets
    that start beyond n are dropped before any row is sorted."""
    b = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 3))
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(_before([], "_bucket")), F.lit(0)).alias("_offset")
    ).where(F.col("_offset") < n)
    # at most 4096 buckets exist, one per three-digit prefix
    kept = b.join(F.broadcast(offsets), "_bucket")
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", *ties))
    return (
        kept.withColumn("_local", local)
        .where(F.col("_local") + F.col("_offset") <= n)
        .drop("_bucket", "_local", "_offset", "_order")
    )


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet NULL keys; the left keys stay."""
    r = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"__{k}"])
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    """The values of `cols` in the row before this one within the key, gaps in `order` allowed."""
    b = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    tail = b.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*cols), order).alias("_tail"))
    carried = tail.select(
        *keys, "_bucket", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    here = b.withColumn("_prev", F.lag(F.struct(*cols)).over(inner))
    joined = join_nullsafe(here, carried, [*keys, "_bucket"]).withColumn("_prev", F.coalesce("_prev", "_carry"))
    for c in cols:
        joined = joined.withColumn(prefix + c, F.col("_prev")[c])
    return joined.drop("_bucket", "_prev", "_carry")


def runs(df: DataFrame, keys: Sequence[str], position: str, value: str, length: int, block: int = 4096) -> DataFrame:
    """All windows of `length` consecutive values as arrays (column `gram`), for rows with contiguous
    0-based `position` per key. The first rows of a block are repeated in the block before it."""
    home = F.floor(F.col(position) / block)
    copies = F.when(
        (F.pmod(F.col(position), F.lit(block)) < length - 1) & (home > 0), F.array(home, home - 1)
    ).otherwise(F.array(home))
    spread = df.select(*keys, position, value, home.alias("_home"), F.explode(copies).alias("_block"))
    w = Window.partitionBy(*keys, "_block").orderBy(position)
    steps = [F.lead(value, i).over(w) if i else F.col(value) for i in range(length)]
    grams = spread.select(
        *keys, position, (F.col("_home") == F.col("_block")).alias("_own"), F.array(*steps).alias("gram"),
        F.lead(position, length - 1).over(w).alias("_last") if length > 1 else F.col(position).alias("_last"),
    )
    return grams.where(F.col("_own") & F.col("_last").isNotNull()).select(*keys, position, "gram")


def _locate(x: Column, cuts: Column, lo: int, hi: int) -> Column:
    """Number of ascending cuts (indexes lo..hi-1, all before lo known to be smaller) below x: a
    search tree of plain comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(cuts[mid] < x, _locate(x, cuts, mid + 1, hi)).otherwise(_locate(x, cuts, lo, mid))


def _cumulate(counts: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Adds to counts `_c` of distinct (_bin, _x) the number of rows before them in the key. The window
    runs inside (key, _bin); bins are shifted by their offsets."""
    sizes = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_size"))
    offsets = sizes.select(
        *keys, "_bin", F.coalesce(F.sum("_size").over(_before(keys, "_bin")), F.lit(0)).alias("_offset")
    )
    upto = Window.partitionBy(*keys, "_bin").orderBy(F.col("_x").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumn("_upto", F.sum("_c").over(upto))
    if parts:
        steps = steps.withColumn("c_all", F.sum("_c").over(Window.partitionBy(*keys, "_bin", "_x")))
    else:
        steps = steps.withColumn("c_all", F.col("_c"))
    return steps.join(offsets, [*keys, "_bin"]).select(
        *keys, *parts, "_x", "_c", "c_all", (F.col("_offset") + F.col("_upto") - F.col("c_all")).alias("below"), "n_key"
    )


def _cuts(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Approximate quantiles `_cuts` (a mergeable sketch) and the row count n_key of each key."""
    return rows.groupBy(*keys).agg(
        F.percentile_approx("_x", list(probs), accuracy).alias("_cuts"), F.count(F.lit(1)).alias("n_key")
    )


def _with_cuts(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], few_keys: bool) -> DataFrame:
    if keys:
        return rows.join(F.broadcast(cuts) if few_keys else cuts, list(keys))
    c = one_row(cuts)
    return rows.select("*", c["_cuts"].alias("_cuts"), c["n_key"].alias("n_key"))


def _numbers(df: DataFrame, keys: Sequence[str], value: str, parts: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *parts, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10000, few_keys: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per key (position q*(n-1)) as columns named by `probs`.
    A sketch with rank error below 1/accuracy brackets each wanted rank; rows outside every bracket
    are only counted, so about 8/accuracy of a key's rows per probability are moved and sorted. Keys
    of at most `accuracy` rows are sorted whole."""
    eps = 4.0 / accuracy
    pairs = sorted((max(0.0, q - eps), min(1.0, q + eps)) for q in probs.values())
    marks = sorted(m for p in pairs for m in p)
    numbers = _numbers(df, keys, value)
    rows = _with_cuts(numbers, _cuts(numbers, keys, marks, accuracy), keys, few_keys)
    x, cuts = F.col("_x"), F.col("_cuts")
    inside = F.col("n_key") <= accuracy
    for lo, hi in pairs:
        inside = inside | ((x >= cuts[marks.index(lo)]) & (x <= cuts[marks.index(hi)]))
    # a bin ends at a cut: values outside the brackets come first in it, then those that are kept
    binned = rows.select(
        *keys, "n_key", _locate(x, cuts, 0, len(marks)).alias("_bin"), F.when(inside, x).alias("_x")
    )
    counts = binned.groupBy(*keys, "n_key", "_bin", "_x").agg(F.count(F.lit(1)).alias("_c"))
    steps = _cumulate(counts, keys, [])
    n1 = F.col("n_key") - 1
    ranks = []
    for q in probs.values():
        ranks += [F.floor(F.lit(q) * n1).cast("bigint"), F.ceil(F.lit(q) * n1).cast("bigint")]
    reached = F.filter(
        F.array_distinct(F.array(*ranks)), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c_all"))
    )
    hits = steps.select(*keys, "n_key", "_x", F.explode(reached).alias("_rank"))
    found = F.when(F.col("_x").isNull(), F.raise_error(F.lit("rank outside its bracket")).cast("double")).otherwise(F.col("_x"))
    hits = hits.withColumn("_x", found)
    out = hits.groupBy(*keys, "n_key").agg(
        *[F.max(F.when(F.col("_rank") == r, F.col("_x"))).alias(f"_v{i}") for i, r in enumerate(ranks)]
    )
    cols = []
    for i, (name, q) in enumerate(probs.items()):
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        pos = F.lit(q) * n1
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)
