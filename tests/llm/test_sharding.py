"""Jump consistent hashing on awkward rows and against the plain walk."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.llm import sharding

M = (1 << 64) - 1


def mixed(x):
    x &= M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def walk(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & M
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_plain_walk():
    keys = [mixed(i) for i in [*range(-50, 3000), 1 << 62, -(1 << 63), (1 << 63) - 1]]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [walk(k, n) for k in keys]


def test_further_shard_takes_rows_only_into_itself():
    keys = np.array([mixed(i) for i in range(20_000)], np.uint64)
    for n in (1, 5, 16, 63):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(a, minlength=n).max() < 1.2 * len(keys) / n


def test_no_shards():
    with pytest.raises(ValueError):
        sharding.place(None, 0)


def rows_of(df, n=16):
    got = [r.asDict() for r in sharding.assign(df, n).collect()]
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return got


@pytest.mark.parametrize("n", [1, 3, 16])
def test_rows(docs, none, n):
    got = rows_of(docs, n)
    want = Counter()
    for r in docs.collect():
        b = (r["text"] or "").encode()
        k = mixed(-1 if r["doc_id"] is None else r["doc_id"])
        want[(r["doc_id"], len(b) + 1, zlib.crc32(b), "key", walk(k, n), walk(k, n + 1))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert sharding.assign(none, n).count() == 0


def test_slots_do_not_depend_on_the_partitions(spark, docs):
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(rows_of(docs), key=key) == sorted(rows_of(docs.repartition(7)), key=key)


def test_one_id_and_one_text_hold_most_rows(spark):
    many = spark.range(3000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(rows_of(many)) == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_written_shards(spark, docs, tmp_path):
    got = {r["shard"]: (r["rows"], r["bytes"]) for r in sharding.write(docs, str(tmp_path / "a")).collect()}
    want = {}
    for r in rows_of(docs):
        n, b = want.get(r["shard"], (0, 0))
        want[r["shard"]] = (n + 1, b + r["size"])
    assert got == want
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    clash = sharding.write(docs.withColumn("shard", F.lit("x")), str(tmp_path / "b"))
    assert {r["shard"]: r["rows"] for r in clash.collect()} == {k: v[0] for k, v in want.items()}
