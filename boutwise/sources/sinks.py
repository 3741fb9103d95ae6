"""Writers: feature and embedding tables, split tables, report rows, file manifests."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A

PIECE = 1 << 20  # bytes read at once by a digest
STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"  # scheme and host of a path


def write_features(features: DataFrame, path: str, names: Sequence[str], partition: str = "partition", mode: str = "errorifexists") -> None:
    """Feature columns as float next to their row metadata, one folder per partition value."""
    as_float = features.withColumns({c: F.col(c).cast("float") for c in names})
    as_float.write.mode(mode).partitionBy(partition).parquet(path)


def write_embeddings(emb: DataFrame, path: str, dim: int, vector: str = "embedding", partition: str = "partition", mode: str = "errorifexists") -> None:
    """Embeddings as array<float>; a wrong length or a non-finite entry fails the write itself."""
    bad = (F.size(vector) != dim) | F.exists(vector, A.nonfinite)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("bad embedding row")).cast("array<float>"))
    emb.withColumn(vector, checked.otherwise(F.col(vector).cast("array<float>"))).write.mode(mode).partitionBy(
        partition
    ).parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """CSV with header; `files=1` only for tables whose size is known to be small (splits)."""
    (df.coalesce(files) if files else df).write.mode(mode).csv(path, header=True)


def report_rows(df: DataFrame, analysis: str, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Any wide result as tidy rows (analysis, ids, metric, value)."""
    return df.unpivot(
        [F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value"
    ).select(F.lit(analysis).alias("analysis"), *ids, "metric", "value")


def report_json(tidy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tidy rows as one JSON document per key: {"metric": value, ...}, metrics in name order."""
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return tidy.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def _below(folder: str) -> Column:
    """A listed file's path below `folder`."""
    base = re.sub(STORE, "", folder)
    base = posixpath.normpath(base if base.startswith("/") else os.path.abspath(base)).rstrip("/") + "/"
    inner = F.regexp_replace("path", STORE, "")
    outside = F.raise_error(F.concat(F.lit(f"not below {base}: "), inner)).cast("string")
    return F.when(inner.startswith(base), F.substr(inner, F.lit(len(base) + 1))).otherwise(outside)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", whole: int = 1 << 28, below: bool = False) -> DataFrame:
    """(name, bytes, sha256) of every file below `path` that isn't empty (Spark's listing skips empty ones). A name is the file's own, or with `below` its path below `path`, which is
    unique where files in several folders share their names. Files of at most `whole` bytes are read by Spark, from any store that it reaches. Larger ones are digested piece by piece, so memory doesn't grow with a file; their store must be one that pyarrow opens on the executors too (shared folder, hdfs, s3, gs),
    another fails the job."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = (_below(path) if below else F.element_at(F.split("path", "/"), -1)).alias("name")
    small = listed.where(F.col("length") <= whole).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > whole).select("path", name, F.col("length").alias("bytes"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for uri in b.column("path").to_pylist():
                system, inner = pa_fs.FileSystem.from_uri(quote(uri, safe="/:"))
                state = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(PIECE):
                        state.update(piece)
                sums.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("bytes"), pa.array(sums, pa.string())], ["name", "bytes", "sha256"])

    spread = large.repartition(spark.sparkContext.defaultParallelism, "path")  # few rows, long work
    return small.unionByName(spread.mapInArrow(digest, "name string, bytes long, sha256 string"))


def verify_manifest(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Each file of either manifest with its status: ok, changed, missing or unrecorded."""
    a = current.select("name", F.col("sha256").alias("_now"))
    b = recorded.select("name", F.col("sha256").alias("_then"))
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_then").isNull(), "unrecorded")
        .when(F.col("_now") == F.col("_then"), "ok")
        .otherwise("changed")
    )
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def folder_statuses(files: DataFrame) -> DataFrame:
    """(name, status) of each file or folder at the top of a verified manifest of paths: the status that all its files share, else changed."""
    same = F.min("status") == F.max("status")
    return files.groupBy(F.split("name", "/")[0].alias("name")).agg(F.when(same, F.min("status")).otherwise("changed").alias("status"))
