"""Ranked lexical search on awkward rows and against a scan of every document for every item."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    docs = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for i, want in wanted.items():
        found = []
        for d, w in docs:
            s = 0
            for t in want & set(w):
                tf, m = w.count(t), 50 + (50 * len(w) * n_docs) // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        found.sort(key=lambda r: r[:3])
        out |= {(i, n + 1, r[3], -r[0]) for n, r in enumerate(found[:k])}
    return out


ITEMS = [(1, "word3 WORD7, word999"), (2, "Übung über übung x"), (3, None), (4, ""), (5, "... --"), (6, "one"), (7, "word3"), (7, "long77 word4"), (None, "token é"),
         (8, " ".join(f"word{i}" for i in range(60))), (9, "wor"), (10, "ord3 7 word"), (11, "absent"), (12, "a b")]
MORE = [(20, "Übung, übung Über", "de"), (21, "word3", "en"), (22, "WORD3.word3-word3", "en"), (23, "a b a b", "en"), (24, "über", None), (25, "\x00word4\x7fword4", "en")]


@pytest.fixture(scope="module")
def corpus(spark, docs):
    return docs.unionByName(spark.createDataFrame([(*r, 5) for r in MORE], docs.schema))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id int, text string, rank string")


@pytest.mark.parametrize("k,block", [(50, ranking.BLOCK_TERMS), (3, 20)])
def test_against_brute_force(corpus, items, k, block):
    got = ranking.search(corpus, items, k, block_terms=block)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = got.collect()
    want = brute([(r["doc_id"], r["text"]) for r in corpus.collect()], ITEMS, k)
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_empty_tables(docs, none, items):
    assert ranking.search(none, items).count() == 0
    assert ranking.search(docs, items.where("false")).count() == 0
    assert ranking.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_ties_across_partitions(spark, items):
    """Thousands of equal documents in many tasks: the smallest ids stay."""
    same = spark.range(3000, numPartitions=9).select((3000 - F.col("id")).alias("doc_id"), F.lit("word3 and more").alias("text"))
    other = spark.range(9000, 9100).select("id", F.lit("other text"))
    got = [r["doc_id"] for r in ranking.search(same.union(other), items.where("item_id = 7"), 5).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_guards_keep_whole_terms():
    find = ranking.automaton("test", ["word", "word3", "3", "é"]).iter
    text = ranking.fold("xword word33 word3 3;word é3 é").decode("latin-1")
    assert [v for _, v in find(text)] == [1, 2, 0, 3]


def test_best_in_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 6, (500, 4)), rng.permutation(500)
    want = [sorted(zip(-scores[:, i], ids))[:7] for i in range(4)]
    best = ranking.Best(4, 7)
    for lo in range(0, 500, 31):
        best.add(scores[lo:lo + 31], ids[lo:lo + 31], np.zeros(len(ids[lo:lo + 31]), bool))
    assert [list(zip(-best.score[i], best.id[i])) for i in range(4)] == want
