"""All-against-all reductions without emitting pairs: both sides are cut into tiles, a task meets
one tile of each side as two matrices and returns one small result per left row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H


def tile_count(df: DataFrame, rows_per_tile: int) -> int:
    return max(1, -(-df.count() // rows_per_tile))


def reduce_tiles(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, tiles: int,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
) -> DataFrame:
    """fn(left tile, right tile) for every pair of tiles; each side is copied once per tile of the
    other, so a group never holds more than one tile of each."""
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = left.withColumn("_lt", (H.draw("tile", left_key) % tiles).cast("int")).withColumn("_rt", every)
    b = right.withColumn("_rt", (H.draw("tile", right_key) % tiles).cast("int")).withColumn("_lt", every)
    return a.groupBy("_lt", "_rt").cogroup(b.groupBy("_lt", "_rt")).applyInPandas(fn, schema)
