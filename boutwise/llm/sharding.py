"""Sharding by jump consistent hashing: a document's id and the number of shards decide its shard, without a table of ring points.

A key walks forward through shard numbers by pseudo-random jumps and stays at the last one below the number of shards. A further shard only ends some walks
one jump later, so rows move into the new shard alone, and only the share that it needs.

Defined results: a null id counts as the id -1; rows of one id share a shard; a null text has no bytes; equal rows get slots of their own; an empty table gives an
empty result; further columns are ignored by `assign` and kept by `write`.

Scale: the texts are read once, in one pass without a shuffle, and leave it as a few numbers a row, which are written as a checkpoint. Only these
are range-partitioned by (shard, hashed id, id, size, checksum, position), so the rows of one id or one text can be spread over tasks as well. Slots are the
positions in that order minus the first of the shard; they come from one count per shard and partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sqltext import scratch
from .textops import mix

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    ahead = np.zeros(len(keys), np.int64)
    walking = np.arange(len(keys)) if shards > 0 else np.empty(0, np.int64)
    while len(walking):
        shard[walking] = ahead[walking]
        with np.errstate(over="ignore"):
            s = state[walking] * np.uint64(2862933555777941757) + np.uint64(1)
        state[walking] = s
        draw = (s >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[walking] = ((shard[walking] + 1) * (2147483648.0 / draw)).astype(np.int64)
        walking = walking[ahead[walking] < shards]
    return shard


def _placer(shards: int):
    @F.pandas_udf("at long, shard int, grown_shard int")
    def place(ids: pd.Series) -> pd.DataFrame:
        key = mix(ids.to_numpy(np.int64).view(np.uint64))
        # with the sign bit turned, signed order is the order of the unsigned key
        at = (key ^ np.uint64(1 << 63)).view(np.int64)
        return pd.DataFrame({"at": at, "shard": jump(key, shards), "grown_shard": jump(key, shards + 1)})

    return place


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, at, shard, grown_shard) in one pass; `at` is the hashed id."""
    if shards < 1:
        raise ValueError("at least one shard")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    return slim.select("*", _placer(shards)(F.coalesce("doc_id", F.lit(-1))).alias("_p")).select("doc_id", "size", "text_crc32", "_p.*")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; grown_shard is the shard under one shard more."""
    rows = scratch(place(docs, shards, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    order = ["shard", "at", F.col("doc_id").asc_nulls_last(), "size", "text_crc32", "_row"]
    # the positions are frozen by a second checkpoint: partition number and place in it
    placed = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33).alias("_part")
    blocks = placed.groupBy("shard", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row a partition and one more a shard, as the partitions are ranges of shards
    offsets = blocks.select(F.col("shard").alias("_shard"), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_p", part).join(F.broadcast(offsets), (F.col("shard") == F.col("_shard")) & (F.col("_p") == F.col("_part")))
    slot = (F.col("_at") - F.col("_first") + F.col("_before")).alias("slot")
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write(docs: DataFrame, folder: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows with all their columns as Parquet below `folder`, one subfolder `shard=n` a shard (`_shard=n` and so on where the documents
    have such a column), and returns the manifest read back from there: (shard, rows, bytes), bytes being the sum of the sizes. Each task
    writes its rows of every shard, so no shard passes through one task."""
    name, taken = "shard", {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    key = _placer(shards)(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))["shard"]
    docs.withColumn(name, key).write.partitionBy(name).parquet(folder)
    back = docs.sparkSession.read.parquet(folder)
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).cast("long") + 1
    return back.groupBy(F.col(name).alias("shard")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
