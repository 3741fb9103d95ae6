"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

1. toxicity: documents whose toxicity is predicted go; texts without words stay.
2. jaccard: of each group of near duplicates the row with the smallest id stays (of equal ids, one).
3. decontamination: documents that hold a benchmark item go.
4. secrets: found credentials are replaced by a mark in the text, and n_chars is counted anew; all documents stay.
5. packing: pieces of at most 1024 tokens with their ids, sequence and offset.

Rows without an id pass every stage as others do; in stage 2 one of them stays only if no row of its group has an id.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from boutwise.llm import decontamination, packing, secrets, similarity, toxicity  # noqa: E402
from boutwise.llm.queries import TOXIC_AT, table, tokenizer_path  # noqa: E402
from boutwise.llm.sqltext import row_key, scratch, small  # noqa: E402


def _rows_at_once(spark: SparkSession, rows: int) -> None:
    """Rows in one Arrow batch. Whole texts pass through Python in every stage, and a batch stands in the JVM and in Python, there and back, for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _rows_at_once(spark, 1_000)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return toxicity.score(docs, chain, docs.columns, suffix="__score").where(F.col("toxic__score") < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are their group's first; texts without words are no one's duplicates and stay."""
    # n-grams that are frequent are told by batch, and no texts come back
    _rows_at_once(spark, 10_000)
    found = similarity.join(docs).where("n_shingles > 0")
    # rows that go: another row of the group is first by (id, nulls last, row_key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    least = scratch(found.groupBy("class_key").agg(F.count("*").alias("__n"), first.alias("__first")).where("__n > 1").drop("__n"))
    gone = scratch(found.join(small(least), "class_key").where("row_key <> __first").select(F.col("row_key").alias("__key")).distinct())
    # and rows with both id and text in common are copies of each other
    again = scratch(found.groupBy(F.col("row_key").alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1").select("__key"))
    kept = docs.withColumn("__key", row_key(F.col("doc_id").cast("long"), F.col("text"))).join(small(gone), "__key", "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(small(again), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.join(small(again), "__key", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _rows_at_once(spark, 1_000)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _rows_at_once(spark, 1_000)
    done = secrets.redact(secrets.scan(docs, secrets.fit(docs), name="__findings"), name="__findings")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _rows_at_once(spark, 1_000)
    return packing.pack(packing.cut_documents(docs, tokenizer_path(), keep_ids=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("jaccard", drop_near_duplicates), ("decontamination", drop_benchmark), ("secrets", mask_secrets), ("packing", pack),
]

# a trained classifier, components and tokenizing have no SQL form; tests/llm compares the stages with brute force
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder for the stages' files below spark.checkpoint.dir; a local session without that setting gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pipeline-")
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
