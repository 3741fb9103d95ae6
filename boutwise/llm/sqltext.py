"""Column expressions over the words of a text, shared by the operators that use DataFrame functions only."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words between the six ASCII blanks; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of the k-word shingles of word hashes in order, repeats included; a shorter text has one, its whole sequence, or none."""
    n = F.size(w)
    return F.when(n == 0, F.expr("cast(array() as array<long>)")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k))))


def row_key(id_col: Column, text: Column) -> Column:
    """Names a row by its content; equal rows share it, and null ids have one too."""
    return F.xxhash64(id_col, text.cast("string"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are few, else the plain frame, which joins by shuffle. Only for frames that are cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def scratch(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names. Where it's unset, a local session gets a folder of its own, and a
    cluster an error, as its executors share no local folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
