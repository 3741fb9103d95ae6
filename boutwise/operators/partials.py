"""Sums of one long vector per task, added by Spark as a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15  # numbers in one row
FAN = 32  # vectors added by one task
DIRECT = 1 << 18  # numbers that may reach the driver before the last addition
SCHEMA = "chunk long, task long, vector binary"


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_py()) for v in table.column("vector")], axis=0)
    return pa.table({"chunk": table.column("chunk")[:1], "task": table.column("task")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


def vector_sum(df: DataFrame, size: int, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> np.ndarray:
    """Sum over all rows of a vector of `size` doubles. In each task start() gives a function from an Arrow batch to its part of the sum. A task sends one vector in rows of
    `CHUNK` numbers; `FAN` of them are added by one task, level by level, until at most `DIRECT` numbers are left or one vector, which reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size), None
        for b in batches:
            if b.num_rows:
                part = part or start()
                total += part(b)
        if part is None:
            return
        task = TaskContext.get().partitionId()
        for c in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int64()), pa.array([task], pa.int64()), pa.array([total[c:c + CHUNK].tobytes()], pa.binary())], ["chunk", "task", "vector"])

    out = df.mapInArrow(run, SCHEMA)
    # metadata only: how many vectors there will be
    tasks = df.rdd.getNumPartitions()
    while tasks > 1 and tasks * size > DIRECT:
        out = out.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("chunk", "task").applyInArrow(_add, SCHEMA)
        tasks = -(-tasks // FAN)
    rows = out.toArrow().sort_by([("chunk", "ascending"), ("task", "ascending")])
    total = np.zeros(size)
    for c, v in zip(rows.column("chunk").to_pylist(), rows.column("vector"), strict=True):
        part = np.frombuffer(v.as_py())
        total[c * CHUNK:c * CHUNK + len(part)] += part
    return total
