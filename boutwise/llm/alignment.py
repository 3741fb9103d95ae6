"""Alignment of two tokenizers over a corpus: which ids of one end where ids of the other end, and how often each pair of ids does so.

Tokenizer A (byte-level pairs) encodes a space and the text, B (pieces with byte fallback) the text, to which it adds the space itself. The byte offsets at which
tokens of both end cut them into groups; a link is an A and a B token that end together. A first pass aligns the documents and gathers the linked
id pairs. The distinct pairs get a minimal perfect hash; their counts are dense vectors in its order, one for each task, summed as a tree. A
second pass aligns the documents again and looks its links up; the pair kept under each number is compared.

A text is cut before every single space between two characters that are no blanks. Neither tokenizer has a token across such a place (A splits
there before it merges, B has no piece with a space after another character), so each distinct stretch is encoded and aligned once and stands for all
its occurrences in a task's window.

Defined results: a text that is null or empty, or whose joined token bytes differ from the space and the text (it holds U+2581), has no tokens: zeros and ''.
Repeated rows and repeated or null ids are documents of their own and all count; an empty table gives an empty result; further columns are ignored.

Scale: both passes read the texts without a shuffle. A task hands on (pair, count) once per window of `UNITS` distinct stretches. Pairs are hashed in blocks of about
`PAIRS`, each built by a task of its own, so no task, driver or broadcast holds more than one block; with several blocks the second pass runs once a
block and its sums are added up by row. What's broadcast is one block (32 MB) and one number per B id.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfecthash import CountTable, PerfectHash
from .sqltext import scratch

UNITS = 400_000
PENDING = 1 << 20  # stretches of documents that wait for the new ones among them to be encoded
PAIRS = 2_000_000
PARTIAL_ROWS = 500_000  # rows summed into one dense vector
CHUNK = 1 << 14  # numbers of a dense vector in one row
LONG = 2000
TOGETHER = 128  # stretches encoded in one call
B_BITS = 24  # a pair is A id << B_BITS | B id

_CUT = re.compile(r"(?<=\S)(?= \S)")
_loaded: dict[tuple[str, str], Aligner] = {}


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 letters for themselves, the other bytes in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        letters = _byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # the rank form of the same vocabulary, where a file of it lies beside, is faster; it serves Latin text, which both split alike
        self.ranks = None
        ranks_path = os.path.splitext(a_path)[0] + ".tiktoken"
        if os.path.exists(ranks_path):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.latin = re.compile("[\x00-\x7f¡-ʯ‐-‧€]*").fullmatch
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # without this property texts are not cut
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))

    def stretches(self, text: str) -> list[str]:
        """The space and the text in pieces that both tokenizers encode apart."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Runs of ids of A and of B; the runs put together encode the units one after the other."""
        a: list[list[int]] = []
        b: list[list[int]] = []
        run: list[str] = []
        # their strings are plain text; set at every use, as a tokenizer kept by a worker was seen to lose it from one task to the next
        self.a.encode_special_tokens = True

        def end() -> None:
            if run:
                whole = "".join(run)
                a.append(self.ranks.encode_ordinary(whole))
                b.append(self.b.encode(whole[1:], num_threads=1))
                run.clear()

        for u in units:
            # plain units follow each other as in one text
            if self.ranks is not None and self.cuts and len(u) < LONG and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and self.latin(u):
                run.append(u)
                if len(run) == TOGETHER:
                    end()
            else:
                end()
                a.append(self.a.encode(u, add_special_tokens=False).ids)
                b.append(self.b.encode(u[1:], num_threads=1))
        end()
        return a, b

    def align(self, units: list[str], names: bool) -> Units:
        flat = lambda runs: np.array([i for r in runs for i in r], np.int64)
        a, b = map(flat, self.encode(units))
        raw = [u.encode() for u in units]
        whole = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return self._one_by_one(units, names)
        ends = np.cumsum([len(r) for r in raw])
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(ends, both).all():
            return self._one_by_one(units, names)
        i, j = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        stop = np.searchsorted(both, ends, "right")
        start = np.concatenate(([0], stop[:-1]))
        tokens = lambda x: np.diff(np.concatenate(([0], np.searchsorted(x, ends, "right"))))
        text = []
        if names:
            an, bn = [self.a_name[x] for x in a.tolist()], [self.b_name[x] for x in b.tolist()]
            groups, p, q = [], 0, 0
            for x, y in zip((i + 1).tolist(), (j + 1).tolist(), strict=True):
                groups.append((an[p] if x - p == 1 else ",".join(an[p:x])) + "|" + (bn[q] if y - q == 1 else ",".join(bn[q:y])))
                p, q = x, y
            text = [";".join(groups[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
        return Units(tokens(a_end), tokens(b_end), np.diff(np.concatenate(([0], stop))), (a[i] << B_BITS) | b[j], np.zeros(len(units), bool), text)

    def _one_by_one(self, units: list[str], names: bool) -> Units:
        """Units among which one's tokens give other bytes; that one is marked."""
        if len(units) == 1:
            return Units(*np.zeros((3, 1), np.int64), np.empty(0, np.int64), np.ones(1, bool), [""] * names)
        half = len(units) // 2
        parts = [self.align(units[:half], names), self.align(units[half:], names)]
        return Units(*[np.concatenate([p[k] for p in parts]) for k in range(5)], [t for p in parts for t in p.text])


class Units:
    """Aligned stretches: numbers of A tokens, B tokens and links (as many as groups), pairs of the links in order, mark of a failed one, groups as text."""

    def __init__(self, n_a, n_b, n_links, pairs, failed, text):
        self.n_a, self.n_b, self.n_links, self.pairs, self.failed, self.text = n_a, n_b, n_links, pairs, failed, text

    def __getitem__(self, k: int) -> np.ndarray:
        return (self.n_a, self.n_b, self.n_links, self.pairs, self.failed)[k]


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def _windows(batches: Iterator[pa.RecordBatch], at: int, tool: Aligner, names: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[Units], bool]]:
    """(waiting batches' rows, stretch numbers of all waiting texts, number per text, aligned stretches so far, whether the numbers begin anew afterwards).
    The aligned stretches grow from yield to yield until they begin anew; a text without tokens has no stretches."""
    known: dict[str, int] = defaultdict(count().__next__)
    done: list[Units] = []
    aligned = waiting = 0
    rows, numbers, per = [], [], []

    def settle() -> tuple:
        nonlocal aligned
        fresh = list(islice(known, aligned, None))
        if fresh:
            done.append(tool.align(fresh, names))
            aligned = len(known)
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        return list(rows), flat, np.array(per, np.int64), done, len(known) > UNITS

    for batch in batches:
        for r, text in enumerate(batch.column(at)):
            text = text.as_py()
            cut = tool.stretches(text) if text and "▁" not in text else []
            numbers.append(np.fromiter(map(known.__getitem__, cut), np.int64, len(cut)))
            rows.append((batch, r))
            per.append(len(cut))
            waiting += len(cut)
            if waiting > PENDING or len(known) > UNITS:
                got = settle()
                yield got
                rows, numbers, per, waiting = [], [], [], 0
                if got[-1]:
                    known, done, aligned = defaultdict(count().__next__), [], 0
    if rows:
        yield (*settle()[:-1], True)


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(per)
    return total[end] - total[end - per]


def _links(a_path: str, b_path: str):
    """(pair, n): linked pairs of a window of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        seen = np.zeros(0, np.int64)
        for _, numbers, per, done, anew in _windows(batches, 0, tool, False):
            failed = np.concatenate([u.failed for u in done]) if done else np.zeros(0, bool)
            if failed.any():
                numbers = numbers[np.repeat(_sums(failed[numbers], per) == 0, per)]
            seen = np.concatenate((seen, np.zeros(len(failed) - len(seen), np.int64))) + np.bincount(numbers, minlength=len(failed))
            if anew:
                if done:
                    pairs, back = np.unique(np.concatenate([u.pairs for u in done]), return_inverse=True)
                    n = np.zeros(len(pairs), np.int64)
                    np.add.at(n, back, np.repeat(seen, np.concatenate([u.n_links for u in done])))
                    # stretches of failed texts alone have no links
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[n > 0]), pa.array(n[n > 0])], ["pair", "n"])
                seen = np.zeros(0, np.int64)

    return run


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _describe(a_path: str, b_path: str, shared, keep_groups: bool):
    """Per text: numbers of tokens, groups and links, and what the table says of its links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        packed, keys, counts, best = shared.value
        table = CountTable(PerfectHash.unpack(packed), keys, counts)
        sums, tops = [], []
        for rows, numbers, per, done, anew in _windows(batches, 1, tool, True):
            for u in done[len(sums):]:
                n = table(u.pairs)
                sums.append(_sums(n, u.n_links))
                tops.append(_sums((n > 0) & (n == best[u.pairs & ((1 << B_BITS) - 1)]), u.n_links))
            whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            failed = _sums(whole([u.failed for u in done])[numbers], per) > 0 if len(numbers) else np.zeros(len(per), bool)
            cols = [np.where(failed, 0, _sums(whole(x)[numbers], per)) for x in ([u.n_a for u in done], [u.n_b for u in done], [u.n_links for u in done], tops, sums)]
            text = [t for u in done for t in u.text]
            flat, digests, groups, lo = numbers.tolist(), [], [], 0
            for n, bad in zip(per.tolist(), failed.tolist(), strict=True):
                g = "" if bad else ";".join(map(text.__getitem__, flat[lo:lo + n]))
                digests.append(hashlib.sha256(g.encode()).hexdigest() if g else "")
                if keep_groups:
                    groups.append(g)
                lo += n
            ids = pa.array([b.column(0)[r].as_py() for b, r in rows], pa.int64())
            number = pa.array([b.column(2)[r].as_py() for b, r in rows], pa.int64())
            out = [ids, number, pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4]), pa.array(digests, pa.string())]
            names = ["doc_id", "row", *[c.split()[0] for c in RESULT.split(", ")]]
            if keep_groups:
                out.append(pa.array(groups, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(out, names)
            if anew:
                sums, tops = [], []

    return run


def _build(table: pa.Table) -> pa.Table:
    """One block of distinct pairs as a perfect hash and the pairs in its order."""
    pairs = table.column("pair").combine_chunks().to_numpy()
    h = PerfectHash.build(pairs)
    ordered = np.empty(len(pairs), np.int64)
    ordered[h(pairs)] = pairs
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "hash": pa.array([h.pack()], pa.binary()), "pairs": pa.array([ordered.tobytes()], pa.binary())})


def _dense(shared):
    """A task's counts as one vector in the order of the hash, in rows of `CHUNK` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = PerfectHash.unpack(shared.value)
        vector = np.zeros(h.n, np.int64)
        for batch in batches:
            np.add.at(vector, h(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        task = TaskContext.get().partitionId()
        for c in range(0, h.n, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int64()), pa.array([task], pa.int64()), pa.array([vector[c:c + CHUNK].tobytes()], pa.binary())], ["chunk", "task", "vector"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("vector"))
    return pa.table({"chunk": table.column("chunk")[:1], "task": table.column("task")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


class PairTables:
    """The blocks of the corpus' linked pairs: perfect hash, pairs and counts, and the highest count of each B id."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", pairs: int = PAIRS, partial_rows: int = PARTIAL_ROWS):
        self.spark = docs.sparkSession
        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        partial = scratch(texts.mapInArrow(_links(a_path, b_path), "pair long, n long"))
        distinct = scratch(partial.select("pair").distinct())
        self.blocks = max(1, -(-distinct.count() // pairs))
        block = F.pmod(F.xxhash64("pair"), F.lit(self.blocks)).alias("block")
        built = distinct.select(block, "pair").groupBy("block").applyInArrow(_build, "block long, hash binary, pairs binary")
        self.built = scratch(built)
        tasks = max(1, -(-partial.count() // (partial_rows * self.blocks)))
        self.sums: list[DataFrame] = []
        size = max(aligner(a_path, b_path).b_len.shape[0], 1)
        self.best = np.zeros(size, np.int64)
        for b in range(self.blocks):
            packed, keys = self._keys(b)
            dense = partial.where(block == b).coalesce(tasks).mapInArrow(_dense(self.spark.sparkContext.broadcast(packed)), "chunk long, task long, vector binary")
            # two levels: the tasks of about the same number first
            near = F.floor(F.col("task") / max(1, round(tasks ** 0.5)))
            schema = "chunk long, task long, vector binary"
            level = dense.withColumn("task", near).groupBy("chunk", "task").applyInArrow(_add, schema).groupBy("chunk").applyInArrow(_add, schema)
            self.sums.append(scratch(level.drop("task")))
            np.maximum.at(self.best, keys & ((1 << B_BITS) - 1), self._counts(b))

    def _keys(self, b: int) -> tuple[bytes, np.ndarray]:
        found = self.built.where(F.col("block") == b).toArrow()
        if not found.num_rows:
            return PerfectHash.build(np.empty(0, np.int64)).pack(), np.empty(0, np.int64)
        return found.column("hash")[0].as_py(), np.frombuffer(found.column("pairs")[0].as_py(), np.int64)

    def _counts(self, b: int) -> np.ndarray:
        rows = self.sums[b].toArrow().sort_by("chunk")
        return np.concatenate([np.empty(0, np.int64), *[np.frombuffer(v.as_py(), np.int64) for v in rows.column("vector")]])

    def shared(self, b: int):
        """Broadcast of block b: at most about `pairs` pairs, and a number per B id."""
        packed, keys = self._keys(b)
        return self.spark.sparkContext.broadcast((packed, keys, self._counts(b), self.best))

    def counts(self) -> DataFrame:
        """(a_id, b_id, n) of all linked pairs."""
        schema = "a_id long, b_id long, n long"

        def rows(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = np.frombuffer(left.column("pairs")[0].as_py(), np.int64)
            vectors = right.sort_by("chunk").column("vector")
            n = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in vectors])
            return pa.table({"a_id": keys >> B_BITS, "b_id": keys & ((1 << B_BITS) - 1), "n": n})

        vectors = None
        for b, part in enumerate(self.sums):
            part = part.withColumn("block", F.lit(b).cast("long"))
            vectors = part if vectors is None else vectors.unionByName(part)
        return self.built.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(rows, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, pairs: int = PAIRS,
          tables: PairTables | None = None) -> DataFrame:
    """Per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with keep_groups also `groups` as text. n_best counts links whose
    pair is its B id's most frequent one, count_sum adds the pairs' counts. `tables` are those of another corpus, by default of this one."""
    tables = tables or PairTables(docs, a_path, b_path, text_col, pairs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "doc_id long, row long, " + RESULT + (", groups string" if keep_groups else "")
    parts = [src.mapInArrow(_describe(a_path, b_path, tables.shared(b), keep_groups), schema) for b in range(tables.blocks)]
    if len(parts) == 1:
        return parts[0].drop("row")
    # the same rows in every part: the sums of the blocks are added, the rest is equal
    every = scratch(parts[0])
    for p in parts[1:]:
        every = every.unionByName(scratch(p))
    added = {"n_best", "count_sum"}
    rest = [c for c in parts[0].columns if c not in added and c != "row"]
    out = every.groupBy("row").agg(*[F.first(c).alias(c) for c in rest], *[F.sum(c).alias(c) for c in sorted(added)])
    return out.select(*[c for c in parts[0].columns if c != "row"])
