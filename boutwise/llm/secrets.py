"""Secret scan: fixed patterns, and automata inferred from the credentials those patterns label.

The values that the patterns find are labelled credentials. For each kind a prefix tree of their character classes is built, and states whose outgoing
and ending frequencies agree within Hoeffding's bound are merged (red-blue order), which leaves a probabilistic automaton of the format. Every
candidate, a run of 16 or more token characters with a letter and a digit, is scored by its bits per character under the background less
those under the automaton; those above the threshold become spans of kind `grammar`. Base spans always stay. The unlabelled candidates are a mixture: the
background is learned from them by expectation-maximisation, each with its probability of being no credential. The threshold is half the gain that labelled
credentials have which their automaton has not seen, and `least_gain` at least, whatever the number of candidates.

Defined results: null and empty texts have no findings; positions are code points, end exclusive; repeated rows are scanned each; without labelled values
there is no automaton and nothing is added; an empty table gives an empty result; other columns pass through `scan` unchanged; the name of
the findings is a parameter, for tables that have such a column.

Scale: one pass without a shuffle. The automata are fitted on the values of at most `fit_documents` documents, taken by hash, and at most `fit_values` values a
kind, each at most `FIT_LENGTH` long (documented bounds of a classifier's sample); everything else covers every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCUMENTS = 20_000
FIT_VALUES = 1_000
FIT_LENGTH = 256
ALPHA = 0.05
LEAST_GAIN = 0.5  # bits per character
HELD = 5  # every fifth labelled value sets the threshold
PRIOR = 256  # characters' worth of the uniform background, so that it cannot learn single values by heart
ROUNDS = 20  # of the background's expectation-maximisation
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

# fixed values: the base patterns
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(f"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "grammar")
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

_CLASSES = {**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"},
            **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TABLE = str.maketrans(_CLASSES)
_BITS = {"9": math.log2(10), "a": math.log2(6), "g": math.log2(20), "A": math.log2(6), "G": math.log2(20)}
_SYMBOLS = "9agAG+/_.=-"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, each kind leftmost and without overlaps."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # a greedy run of 32 or more always begins where the run begins
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, spans: list) -> list[tuple[int, int, str]]:
    """Candidate runs that overlap no base span."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        v = m[0]
        if not _DIGIT.search(v) or not _LETTER.search(v):
            continue
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < b and spans[j][1] <= a:
            j += 1
        # spans come by start, so none after the first that begins behind the run can meet it
        if j == len(spans) or spans[j][0] >= b:
            out.append((a, b, v))
    return out


class Automaton:
    """Probabilistic automaton by state merging. Nodes: children by symbol, counts by symbol, ends, visits."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.visits = [0]
        for v in values:
            at = 0
            self.visits[0] += 1
            for c in v.translate(_TABLE):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _apart(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._apart(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._apart(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            seen = set(red)
            blue = [(p, c, q) for p in red for c, q in sorted(self.next[p].items()) if q not in seen]
            if not blue:
                return
            # the most visited first, as its frequencies are the surest
            p, c, q = max(blue, key=lambda x: (self.visits[x[2]], -x[2]))
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)

    def bits(self, value: str) -> float:
        """-log2 of the value's probability under the format (its characters, and the end); additive smoothing over symbols."""
        at, total = 0, 0.0
        for ch in value:
            c = _CLASSES.get(ch, ch)
            n = self.visits[at] if at is not None else 0
            k = self.count[at].get(c, 0) if n else 0
            total += -math.log2((k + 0.05) / (n + 0.05 * (len(_SYMBOLS) + 1))) + _BITS.get(c, 0.0)
            at = self.next[at].get(c) if n else None
        return total


class Model:
    """One automaton a kind, a background of single characters, and the least gain in bits per character."""

    def __init__(self, positives: dict[str, list[str]], negatives: list[str], alpha: float = ALPHA, least_gain: float = LEAST_GAIN):
        self.automata = {k: Automaton(v, alpha) for k, v in sorted(positives.items()) if v}
        # unlabelled candidates may be credentials: each counts for the background with its probability of not being one
        cost = [min(a.bits(v) for a in self.automata.values()) for v in negatives] if self.automata else []
        # from two starts, no candidate a credential and all of them, as either can be a local optimum; the likelier end is kept
        ends = [self._mixture(negatives, cost, start) for start in ((1.0, 0.0) if cost else (1.0,))]
        self._learn(negatives, max(ends, key=lambda e: e[0])[1])
        self.least = least_gain
        bars = []
        for v in positives.values():
            held, rest = v[::HELD], [x for i, x in enumerate(v) if i % HELD]
            if rest:
                a = Automaton(rest, alpha)
                gains = sorted((sum(self.background[c] for c in x) - a.bits(x)) / len(x) for x in held)
                bars.append(gains[int(0.05 * (len(gains) - 1))])
        if bars:
            self.least = max(least_gain, min(bars) / 2)

    def _mixture(self, values: list[str], cost: list[float], start: float) -> tuple[float, list[float]]:
        """(log2 likelihood, each value's probability of being no credential); cost: the values' bits under the automata."""
        share, total = [start] * len(values), 0.0
        for _ in range(ROUNDS if cost else 0):
            self._learn(values, share)
            plain = (sum(share) + 1) / (len(share) + 2)
            total, fresh = 0.0, []
            for v, c in zip(values, cost, strict=True):
                x, y = math.log2(plain) - sum(self.background[k] for k in v), math.log2(1 - plain) - c
                high = max(x, y)
                both = high + math.log2(2.0 ** max(-500.0, x - high) + 2.0 ** max(-500.0, y - high))
                total += both
                fresh.append(2.0 ** max(-500.0, x - both))
            settled = max(abs(x - y) for x, y in zip(fresh, share, strict=True)) < 1e-3
            share = fresh
            if settled:
                break
        return total, share

    def _learn(self, values: list[str], share: list[float]) -> None:
        """At most two thirds of the weight goes to what the text's own runs look like, the rest to any token character."""
        n = dict.fromkeys(TOKEN_CHARS, 0.0)
        for v, w in zip(values, share, strict=True):
            for c in v:
                n[c] += w
        total = sum(n.values())
        own = total / (total + PRIOR) * 2 / 3
        self.background = {c: -math.log2((n[c] / total * own if total > 0 else 0.0) + (1 - own) / len(TOKEN_CHARS)) for c in TOKEN_CHARS}

    def gain(self, value: str) -> float:
        if not self.automata:
            return -math.inf
        plain = sum(self.background[c] for c in value)
        return (plain - min(a.bits(value) for a in self.automata.values())) / len(value)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values = [], []
        for t in batch.column(0).to_pylist():
            if t:
                spans = base_spans(t)
                for _, _, k, v in spans:
                    kinds.append(k)
                    values.append(v)
                for _, _, v in candidates(t, spans):
                    kinds.append("none")
                    values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def fit(docs: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS, fit_values: int = FIT_VALUES, alpha: float = ALPHA,
        least_gain: float = LEAST_GAIN) -> Model:
    """Automata from the values found in at most about `fit_documents` documents, at most `fit_values` distinct values a kind, taken by hash."""
    share = min(1.0, fit_documents / max(1, docs.count()))
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    if share < 1:
        some = some.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = some.mapInArrow(_examples, "kind string, value string").where(F.length("value") <= FIT_LENGTH).groupBy("kind", "value").agg(F.lit(1).alias("one")).persist()
    try:
        got = {k: [r[0] for r in found.where(F.col("kind") == k).select("value").orderBy(F.xxhash64("value"), "value").limit(fit_values).collect()]
               for k in ("assign", "access", "hex", "none")}
    finally:
        found.unpersist()
    return Model({k: got[k] for k in ("assign", "access", "hex")}, got["none"], alpha, least_gain)


FINDINGS = "array<struct<kind:string,start:long,end:long,score:double>>"


def _scan(model: Model, at: int, name: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                rows = []
                if t:
                    spans = base_spans(t)
                    rows = [{"kind": k, "start": a, "end": b, "score": None} for a, b, k, _ in spans]
                    if model.automata:
                        for a, b, v in candidates(t, spans):
                            g = model.gain(v)
                            if g > model.least:
                                rows.append({"kind": "grammar", "start": a, "end": b, "score": g})
                        rows.sort(key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"]))
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, name])

    return run


def scan(docs: DataFrame, model: Model, text_col: str = "text", name: str = "findings") -> DataFrame:
    """All columns of docs, and findings: kind, start, end, score (of grammar spans), by start."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scan(model, docs.columns.index(text_col), name), f"{schema}, `{name}` {FINDINGS}")


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]", name: str = "findings") -> DataFrame:
    """The text with every span replaced by a mark; overlapping spans give one mark."""
    merged = F.aggregate(
        name, F.expr("cast(array() as array<struct<a:long,b:long>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["end"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b"))))))
    done = F.aggregate(
        merged, F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("p")),
        lambda acc, x: F.struct(F.concat(acc["t"], F.substring(F.col(text_col), (acc["p"] + 1).cast("int"), (x["a"] - acc["p"]).cast("int")), F.lit(mark)).alias("t"), x["b"].alias("p")))
    whole = F.concat(done["t"], F.substring(F.col(text_col), (done["p"] + 1).cast("int"), F.length(text_col)))
    return scanned.withColumn(text_col, F.when(F.size(name) > 0, whole).otherwise(F.col(text_col))).drop(name)
