"""Alignment of two tokenizers on awkward rows and against whole texts aligned one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from boutwise.llm import alignment
from boutwise.llm.perfecthash import CountTable, PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b", " x", "  two   spaces ", "\tq\n z \n", "é<s> <|endoftext|>ﬁ </s>", "▁a b", "　x y", "<0x41> <unk>", "a\x00b c", "x ", " ", "\n\n", "it's  we'll 12345 !!! ... ñandú Straße",
         "日本語 のテキスト и русский 👩‍👩‍👧 é é", "z" * 5000, "w " * 3000, "a b  c \x1cd\x85 e", "don ’t “quoted” text… end", "tab\t tab \ttab", " ​zero width",
         "1 2 3 44 555 \r\n next", "ﷺ ǅ ௵"]


def brute(texts):
    """(per text tuple, pair counts) by whole texts and the tokenizers' own decoding."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sb = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in plain}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found, count = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        raw = (" " + t).encode()
        a, b = ta.encode(" " + t, add_special_tokens=False).ids, sb.encode(t)
        ab = [bytes(letter[c] for c in ta.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if sb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sb.id_to_piece(i)) for i in b)]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            found.append(None)
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        at_a, at_b = dict(zip(ae, range(len(a)))), dict(zip(be, range(len(b))))
        ends = sorted(set(ae) & set(be))
        links = [(a[at_a[e]], b[at_b[e]]) for e in ends]
        groups, p, q = [], 0, 0
        for e in ends:
            x, y = at_a[e] + 1, at_b[e] + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            p, q = x, y
        count.update(links)
        found.append((len(a), len(b), links, groups))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n = [count[k] for k in f[2]]
            best = sum(c == top[y] for c, (_, y) in zip(n, f[2]))
            rows.append((f[0], f[1], len(f[3]), len(f[2]), best, sum(n), hashlib.sha256(";".join(f[3]).encode()).hexdigest()))
    return rows, count


@pytest.fixture(scope="module")
def corpus(spark, docs):
    extra = spark.createDataFrame([(100 + i, t, "xx", 0) for i, t in enumerate(TEXTS)], docs.schema)
    return docs.unionByName(extra)


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 400])
def test_against_whole_texts(corpus, pairs):
    got = alignment.align(corpus, A, B, pairs=pairs)
    assert got.dtypes[:1] == [("doc_id", "bigint")] and all(t == "bigint" for c, t in got.dtypes if c != "groups_sha256")
    rows = corpus.select("doc_id", "text").collect()
    want, _ = brute([r["text"] for r in rows])
    assert Counter(tuple(r) for r in got.collect()) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))


def test_pair_counts_and_groups(corpus, none):
    tables = alignment.PairTables(corpus, A, B, pairs=500, partial_rows=100)
    _, count = brute([r["text"] for r in corpus.collect()])
    assert tables.blocks > 1
    assert {(r["a_id"], r["b_id"]): r["n"] for r in tables.counts().collect()} == dict(count)
    got = alignment.align(corpus, A, B, keep_groups=True, tables=tables).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)
    assert alignment.align(none, A, B).count() == 0


def test_sampled_texts_in_small_windows(spark, monkeypatch):
    """Windows that begin anew within a batch give the same rows."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, count = brute([r["text"] for r in rows])
    tool = alignment.aligner(A, B)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [r["doc_id"] for r in rows], "text": [r["text"] for r in rows], "row": list(range(len(rows)))})
    monkeypatch.setattr(alignment, "UNITS", 3000)
    monkeypatch.setattr(alignment, "PENDING", 7000)
    got = Counter()
    for b in alignment._links(A, B)(iter([pa.RecordBatch.from_arrays([batch.column(1)], ["text"])])):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == Counter({x << alignment.B_BITS | y: n for (x, y), n in count.items()})
    keys = np.array(sorted(got), np.int64)
    h = PerfectHash.build(keys)
    ordered, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    ordered[h(keys)], n[h(keys)] = keys, [got[k] for k in keys.tolist()]
    best = np.zeros(len(tool.b_len), np.int64)
    np.maximum.at(best, ordered & ((1 << alignment.B_BITS) - 1), n)
    shared = type("S", (), {"value": (h.pack(), ordered, n, best)})
    out = [tuple(r[c] for c in r if c not in ("doc_id", "row")) for b in alignment._describe(A, B, shared, False)(iter([batch])) for r in b.to_pylist()]
    assert out == want


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 200_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        h = PerfectHash.unpack(PerfectHash.build(keys).pack())
        at = h(keys)
        assert h.n == len(keys) and sorted(at.tolist()) == list(range(len(keys)))
        ordered = np.empty(len(keys), np.int64)
        ordered[at] = keys
        table = CountTable(h, ordered, ordered % 97)
        assert (table(keys) == keys % 97).all()
        assert (table(keys ^ (1 << 62 | 1)) == 0).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))


def test_query_over_many_partitions(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = (alignment.align(x, A, B).orderBy("doc_id").collect() for x in (d, d.repartition(13)))
    assert a == b
    assert alignment.align(d.where(F.col("doc_id") < 0), A, B).collect() == []
