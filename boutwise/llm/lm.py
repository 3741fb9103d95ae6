"""Text scores of a small causal self-attention model over subword ids, beside exact word counts.

The model reads the subword ids of the lower-cased words (each with a blank before it) of a public vocabulary. The most frequent ids are symbols of their own, the others
share a few classes within which they have their smoothed frequency, so every id has a probability. One attention layer with a residual part is trained in numpy by Adam:
some texts give a common start, then every training text is learned from once, in rounds; in a round each task goes on from the same weights with its texts, and
the tasks' weights are averaged by their targets. A text is cut into blocks; each block is scored once, with itself and the block before as
context, many windows at a time under a causal mask. The probability of each word, the product over its subwords, is then mixed
half and half with the word's smoothed frequency, so that neither a common word nor an unseen one is badly off.

Defined results: a null or empty text is the end token alone; words unknown to the counts have c = 0; repeated rows are scored each; null ids are kept and count as empty
text for the split; without training text the model is uniform over its symbols; an empty table gives an empty result; extra columns are ignored.

Scale: word counts are partial sums and one shuffle of distinct words. The `FREQUENT` most frequent words are broadcast (a fixed bound); tokens of other words go to
their exact counts by a shuffle join, where no key is hot, with their probability by attention, and come back as sums per row of base scores and of mixtures, so
a text's score does not depend on which words are broadcast. Ids are counted from the distinct words. Rounds send one vector of weights a task, added
as a tree; the start takes at most about `fit_documents` texts, by hash. Learning and scoring are passes without a shuffle.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.partials import vector_sum
from .sqltext import scratch
from .textops import slices, word_hashes, word_table

FREQUENT = 300_000
FIT_DOCUMENTS = 1_500
SYMBOLS = 512
CLASSES = 16
DIM = 16
BLOCK = 12
STEPS = 900
BATCH = 256
RATE = 4e-3
ROUNDS = (3e-3, 2e-3, 1e-3)  # rates
SCORED = 1_024  # windows scored at once
WEIGHT = 0.5  # of the attention model against the word frequencies
END_HASH = 0x454E44  # the end token's place among word hashes

_BLANK = re.compile(r"[^\S ]")
_encoders: dict[str, object] = {}


def _encode(path: str):
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path].encode_ordinary


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


def _width_sums(a: np.ndarray) -> np.ndarray:
    return np.matmul(a, np.ones((a.shape[-1], 1), a.dtype))


def _exp(a: np.ndarray) -> np.ndarray:
    """Exponentials in place, of at most 60; most arrays are below that and only looked through."""
    if a.max(initial=0) > 60:
        np.minimum(a, 60, out=a)
    return np.exp(a, out=a)


def _row_sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own[first]] = np.add.reduceat(rows.take(order, 0), first, 0)
    return out


class Attention:
    """x = E + P; q, k, v = x W; out = x + softmax(q k) v; a symbol's probability is that of its group, softmax(out C + c), times its own in the group,
    softmax(out U[group] + u[group]). Symbols 0..n-1 (the last is the end), n: start, n + 1: padding."""

    def __init__(self, n: int, bias: np.ndarray, seed: int = 11, dim: int = DIM, block: int = BLOCK):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) * 0.1).astype(np.float32)
        self.n, self.block, self.groups = n, block, max(1, int(np.sqrt(n / 2)))
        self.members = -(-n // self.groups)
        # places of the last group that no symbol has are never drawn
        own = np.full(self.groups * self.members, -1e9)
        own[:n] = bias
        own = own.reshape(self.groups, self.members)
        whole = np.log(np.maximum(np.exp(own).sum(1), 1e-30))
        self.shapes = {"E": (n + 2, dim), "P": (2 * block, dim), "W": (dim, 3 * dim), "C": (dim, self.groups), "c": (self.groups,), "U": (self.groups, dim, self.members), "u": (self.groups, self.members)}
        self.p = {k: r(*v) for k, v in self.shapes.items()}
        self.p["c"], self.p["u"] = whole.astype(np.float32), np.maximum(own - whole[:, None], -1e9).astype(np.float32)
        self.mask = np.where(np.tri(2 * block), 0, -1e9).astype(np.float32)

    def _weights(self, q: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Softmax of the products under the causal mask; a text's first block has no block before it."""
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.mask[-a.shape[1]:]
        if a.shape[1] == self.block:
            a[np.flatnonzero(s[:, 0] == self.n + 1), :, :self.block] = -1e9
        _exp(a)
        a *= 1 / _width_sums(a)
        return a

    def _output(self, o: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of flat rows, each with a one at its end, and their symbols, in order of the symbols' groups: the rows, exponentials of the groups, of the members of the
        own group, where y's stand in both, that order, each group's end in it."""
        group, member = np.divmod(y.astype(np.uint16), np.uint16(self.members))
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        among, inner = o.take(order, 0), np.empty((len(o), self.members), o.dtype)
        # the ones take the biases into the products
        outer, inside = among @ np.concatenate((self.p["C"], self.p["c"][None])), np.concatenate((self.p["U"], self.p["u"][:, None]), 1)
        lo = 0
        for g, hi in enumerate(ends):
            if hi > lo:
                np.matmul(among[lo:hi], inside[g], out=inner[lo:hi])
            lo = hi
        row = np.arange(len(o))
        return among, _exp(outer), _exp(inner), row * self.groups + group[order], row * self.members + member[order], order, ends

    def step(self, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the windows' last places, as many as y has (weights w), and its gradients."""
        p, m, d = self.p, s.shape[1] - y.shape[1], DIM
        # queries are scaled with their weights
        scaled = p["W"].copy()
        scaled[:, :d] *= 1 / np.sqrt(d)
        x = p["E"].take(s, 0)
        x += p["P"]
        t = (x.reshape(-1, d) @ scaled).reshape(*s.shape, 3 * d)
        q, k, v = t[:, m:, :d], t[..., d:2 * d], t[..., 2 * d:]
        a = self._weights(q, k, s)
        seen = a @ v
        o, total = np.ones((*y.shape, d + 1), x.dtype), max(1.0, float(w.sum()))
        np.add(seen, x[:, m:], out=o[..., :d])
        among, outer, inner, at, own, order, ends = self._output(o.reshape(-1, d + 1), y.ravel())
        each = (w.ravel() / total).astype(o.dtype)[order]
        loss = 0.0
        for e, place in ((outer, at), (inner, own)):
            whole, drawn = _width_sums(e)[:, 0], e.take(place)
            drawn /= whole
            loss -= float(np.log(drawn + 1e-12) @ each)
            e *= (each / whole)[:, None]
            drawn -= 1
            drawn *= each
            e.reshape(-1)[place] = drawn
        both = among.T @ outer
        g = {"C": both[:d], "c": both[d], "U": np.zeros_like(p["U"]), "u": np.zeros_like(p["u"])}
        back, lo = np.empty((len(among), d), o.dtype), 0
        for i, hi in enumerate(ends):
            if hi > lo:
                both = among[lo:hi].T @ inner[lo:hi]
                g["U"][i], g["u"][i] = both[:d], both[d]
                np.matmul(inner[lo:hi], p["U"][i].T, out=back[lo:hi])
            lo = hi
        back += outer @ p["C"].T
        dh = np.empty_like(back)
        dh[order] = back
        dh = dh.reshape(seen.shape)
        # gradients of q, k and v beside each other
        dt = np.empty_like(t)
        dt[:, :m, :d] = 0
        da = dh @ v.transpose(0, 2, 1)
        np.matmul(a.transpose(0, 2, 1), dh, out=dt[..., 2 * d:])
        seen *= dh
        da -= _width_sums(seen)
        da *= a
        np.matmul(da, k, out=dt[:, m:, :d])
        np.matmul(da.transpose(0, 2, 1), q, out=dt[..., d:2 * d])
        g["W"] = _outer(x, dt)
        g["W"][:, :d] *= 1 / np.sqrt(d)
        dx = (dt.reshape(-1, 3 * d) @ scaled.T).reshape(x.shape)
        dx[:, m:] += dh
        g["P"] = dx.sum(0)
        g["E"] = _row_sums(s.ravel().astype(np.uint16), dx.reshape(-1, d), self.n + 2)
        return loss, g

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            self.p[k] = flat[at:at + size].reshape(shape)
            at += size

    def tables(self) -> dict:
        """The symbols' queries, keys and values, and the places', worked out once, as both enter linearly: inputs beside queries, keys beside values."""
        out = {}
        for name in "EP":
            t = self.p[name] @ self.p["W"]
            out[name] = np.concatenate((self.p[name], t[:, :DIM] * np.float32(1 / np.sqrt(DIM))), 1), np.ascontiguousarray(t[:, DIM:])
        return out

    def log10(self, t: dict, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 probabilities of y at the second halves of the windows s."""
        m = self.block
        mine, others = t["E"][0].take(s[:, m:], 0), t["E"][1].take(s, 0)
        mine += t["P"][0][m:]
        others += t["P"][1]
        o = np.ones((*y.shape, DIM + 1), mine.dtype)
        np.add(np.matmul(self._weights(mine[..., DIM:], others[..., :DIM], s), others[..., DIM:]), mine[..., :DIM], out=o[..., :DIM])
        _, outer, inner, at, own, order, _ = self._output(o.reshape(-1, DIM + 1), y.ravel())
        both = outer.take(at) * inner.take(own)
        both /= (_width_sums(outer) * _width_sums(inner))[:, 0]
        found = np.empty_like(both)
        found[order] = np.log10(np.maximum(both, 1e-30))
        return found.reshape(y.shape)


class Adam:
    """Steps on all weights of a net as one vector."""

    def __init__(self, net: Attention):
        self.net, self.w, self.t = net, net.flat(), 0
        net.put(self.w)
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def step(self, s: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> float:
        loss, grad = self.net.step(s, y, w)
        d = np.concatenate([grad[k].ravel() for k in self.net.shapes])
        self.t += 1
        self.m += np.float32(0.1) * (d - self.m)
        d *= d
        self.v += np.float32(0.01) * (d - self.v)
        self.w -= np.float32(rate / (1 - 0.9 ** self.t)) * self.m / (np.sqrt(self.v * np.float32(1 / (1 - 0.99 ** self.t))) + np.float32(1e-8))
        return loss


def stretches(symbols: np.ndarray, size: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, weight 1 where a target counts) of texts given as symbols one after the other, `size` each, cut into pieces of `width`."""
    start, pad, end = n, n + 1, n - 1
    cuts = -(-(size + 1) // width)
    first = (np.cumsum(cuts) - cuts) * width
    total = int(cuts.sum()) * width
    x, y, w = np.full(total + 1, pad, np.uint16), np.zeros(total, np.uint16), np.zeros(total, np.float32)
    place = np.arange(len(symbols)) + np.repeat(first - (np.cumsum(size) - size), size)
    y[place] = symbols
    x[place + 1] = symbols
    w[place] = 1
    y[first + size], w[first + size], x[first] = end, 1, start
    return tuple(v[:total].reshape(-1, width) for v in (x, y, w))


def windows(symbols: np.ndarray, size: np.ndarray, n: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs of two blocks, targets, whether a target counts, its text) of texts given as symbols one after the other, `size` each."""
    x, y, w = stretches(symbols, size, n, block)
    blocks = -(-(size + 1) // block)
    before = np.concatenate((np.full((1, block), n + 1, x.dtype), x[:-1])) if len(x) else x
    before[np.cumsum(blocks) - blocks] = n + 1
    return np.concatenate((before, x), 1), y, w > 0, np.repeat(np.arange(len(size)), blocks)


def _joined(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other with a blank before each, and where each begins, with the end of all."""
    size = ends - starts + 1
    edge = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    out = b[np.maximum(0, np.arange(edge[-1]) + np.repeat(starts - 1 - edge[:-1], size))]
    out[edge[:-1]] = 32
    return out, edge


class Speller:
    """Subword ids of words, each with a blank before it; one call of the tokenizer for many words."""

    def __init__(self, path: str):
        _encode(path)
        encoding = _encoders[path]
        self.path, self.vocabulary = path, encoding.n_vocab
        self.bytes = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(self.vocabulary)], np.int64)

    def spell(self, joined: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        text, encode, n = joined.tobytes().decode("utf-8", "replace"), _encode(self.path), len(edge) - 1
        if _BLANK.search(text):
            # blanks beyond ASCII could be cut together with a neighbour's
            data, each = joined.tobytes(), []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                each.append(encode(data[lo:hi].decode("utf-8", "replace")))
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        ids = np.array(encode(text), np.int64)
        # an id belongs to the word in which its bytes begin
        begin = np.cumsum(self.bytes[ids]) - self.bytes[ids]
        return ids, np.bincount(np.searchsorted(edge, begin, "right") - 1, minlength=n)[:n]


class Words:
    """The most frequent words by hash: their counts and, one after the other, their subword ids as symbols."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, spelled: np.ndarray, size: np.ndarray, model: Model):
        """keys: in order."""
        self.keys, self.count, self.size = keys, count, size
        self.begin = np.cumsum(size) - size
        # keys by their leading bits, about two places a key
        self.shift = np.uint64(64 - min(40, 1 + len(keys).bit_length()))
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.symbols = model.symbol[spelled]
        self.rarity = np.bincount(np.repeat(np.arange(len(keys)), size), model.within[spelled], len(keys))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, whether it's there)."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        lead = (h >> self.shift).astype(np.int64)
        place, end = self.first[lead], self.first[lead + 1]
        found = self.keys.take(place, mode="clip") == h
        left = np.flatnonzero(~found & (place + 1 < end))
        while len(left):
            place[left] += 1
            hit = self.keys[place[left]] == h[left]
            found[left[hit]] = True
            left = left[~hit]
            left = left[place[left] + 1 < end[left]]
        return place, found


class Model:
    """Symbols of subword ids, and the attention model over them."""

    def __init__(self, speller: Speller, count: np.ndarray, texts: int, symbols: int = SYMBOLS, classes: int = CLASSES):
        """count: of each id in the training texts."""
        self.speller = speller
        order = np.lexsort((np.arange(len(count)), -count))
        own = symbols - classes - 1
        self.symbol = np.zeros(len(count), np.uint16)
        self.symbol[order[:own]] = np.arange(own)
        rest = order[own:]
        mass = np.cumsum(count[rest] + 0.1)
        self.symbol[rest] = own + np.minimum(classes - 1, (mass / mass[-1] * classes).astype(int))
        smooth = count + 0.1
        inside = np.bincount(self.symbol, smooth, symbols)
        self.within = np.where(self.symbol >= own, np.log10(smooth / inside[self.symbol]), 0.0)
        total = np.append(np.bincount(self.symbol, count, symbols)[:symbols - 1], texts) + 1.0
        self.net = Attention(symbols, np.log(total / total.sum()))
        self.t, self.targets, self.losses = self.net.tables(), 0, []

    def put(self, flat: np.ndarray) -> None:
        self.net.put(flat.astype(np.float32))
        self.t = self.net.tables()

    def symbols(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, words: Words, place: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of the words one after the other, number of each word's, rarity of each word within its symbols); place, found: of the hashes among `words`."""
        other = np.flatnonzero(~found)
        _, at, inverse = np.unique(hashes[other], return_index=True, return_inverse=True)
        spelled, length = self.speller.spell(*_joined(b, starts[other[at]], ends[other[at]])) if len(at) else (np.empty(0, np.int64), np.empty(0, np.int64))
        size, begin, rarity = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64), np.empty(len(hashes))
        if found.any():
            size[found], begin[found], rarity[found] = words.size[place[found]], words.begin[place[found]], words.rarity[place[found]]
        size[other], begin[other] = length[inverse], (np.cumsum(length) - length)[inverse] + len(words.symbols)
        rarity[other] = np.bincount(np.repeat(np.arange(len(at)), length), self.within[spelled], len(at))[inverse]
        flat = np.concatenate((words.symbols, self.symbol[spelled]))
        return flat[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)], size, rarity

    def learn(self, adam: Adam, symbols: np.ndarray, size: np.ndarray, rate: Callable[[int], float], g: np.random.Generator, batch: int = BATCH) -> tuple[int, float]:
        """One pass over texts given as symbols one after the other, `size` each: (number of targets, sum of their losses)."""
        (s, y, w), total = stretches(symbols, size, self.net.n, 2 * self.net.block), 0.0
        for k in np.array_split(g.permutation(len(s)), max(1, round(len(s) / batch))):
            if len(k):
                total += adam.step(s[k], y[k], w[k], rate(adam.t + 1)) * float(w[k].sum())
        return int(w.sum()), total

    def score(self, symbols: np.ndarray, size: np.ndarray, rarity: np.ndarray, counts: np.ndarray, plain: np.ndarray, plain_end: float) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each text of a slice, that of each word by attention alone). Every word and end is a mixture: WEIGHT of its probability by attention,
        the rest of its frequency; plain: log10 of that, not a number if it isn't at hand, and such words are left out of the sums."""
        doc = np.repeat(np.arange(len(counts)), counts)
        per = np.bincount(doc, size, len(counts)).astype(np.int64)
        s, y, w, _ = windows(symbols, per, self.net.n)
        parts = [self.net.log10(self.t, s[lo:lo + SCORED], y[lo:lo + SCORED])[w[lo:lo + SCORED]] for lo in range(0, len(s), SCORED)]
        # the targets in order: each text's symbols, then its end; a unit is a word or an end
        last, at = np.cumsum(counts) + np.arange(len(counts)), np.arange(len(size)) + doc
        units = np.ones(len(size) + len(counts), np.int64)
        units[at] = size
        value = np.add.reduceat(np.concatenate(parts).astype(float), np.cumsum(units) - units)
        value[at] += rarity
        base = np.full(len(value), plain_end)
        base[at] = plain
        high = np.maximum(value, base)
        mixed = high + np.log10(WEIGHT * 10 ** (value - high) + (1 - WEIGHT) * 10 ** (base - high))
        mixed[np.isnan(base)] = 0.0
        return np.bincount(np.append(doc, np.arange(len(counts))), np.append(mixed[at], mixed[last]), len(counts)), value[at]


def held_out(id_col: str, by: int = 5, rest: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by)) == rest


def _words(column: pa.Array) -> Iterator[tuple]:
    """(first row, bytes, starts, ends, hashes, words per text) of slices."""
    for first, data, offsets in slices(column):
        b, starts, ends, counts = word_table(data, offsets)
        yield first, b, starts, ends, word_hashes(b, starts, ends), counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a batch with a blank before it, its hash and count; the end token has no word."""
    for batch in batches:
        keys, n, data, size = [], [], [], []
        for _, b, starts, ends, h, _ in _words(batch.column(0)):
            k, at, c = np.unique(h, return_index=True, return_counts=True)
            joined, edge = _joined(b, starts[at], ends[at])
            keys, n, data, size = [*keys, k], [*n, c], [*data, joined], [*size, np.diff(edge)]
        none = pa.RecordBatch.from_arrays([pa.array([END_HASH], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([None], pa.binary())], ["h", "c", "word"])
        if batch.num_rows:
            yield none
        if keys:
            every, data, size = np.concatenate(keys), np.concatenate(data), np.concatenate(size)
            k, at, inverse = np.unique(every, return_index=True, return_inverse=True)
            start = np.cumsum(size) - size
            # the joined words are words with a blank before them already
            flat, edge = _joined(data, start[at] + 1, (start + size)[at])
            words = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.bincount(inverse, np.concatenate(n), len(k)).astype(np.int64)), words], ["h", "c", "word"])


def _id_counts(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = told.value
        total = np.zeros(speller.vocabulary)
        for batch in batches:
            ids, size = speller.spell(*_column(batch.column(1)))
            total += np.bincount(ids, np.repeat(batch.column(0).to_numpy().astype(float), size), speller.vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids].astype(np.int64))], ["id", "c"])

    return run


def _column(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each value begins, with the end of all."""
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8), off - off[0]


def _sample(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = told.value
        for batch in batches:
            out = []
            for _, b, starts, ends, h, counts in _words(batch.column(0)):
                symbols, size, _ = model.symbols(b, starts, ends, h, words, *words.find(h))
                out += np.split(symbols.astype(np.int32), np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), size, len(counts)).astype(np.int64))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["symbols"])

    return run


def _learn(told, top: float, turn: int):
    """For `vector_sum`: a task starts from the weights told and learns from its texts one after the other. It gives its weights times its targets, and the targets."""

    def start() -> Callable[[pa.RecordBatch], np.ndarray]:
        model, words = told.value
        net = Attention(model.net.n, np.zeros(model.net.n))
        net.p = dict(model.net.p)
        adam, seen, part = Adam(net), 0, 0

        def learn(batch: pa.RecordBatch) -> np.ndarray:
            nonlocal seen, part
            before, already, lost = adam.w.astype(float) * seen, seen, 0.0
            for _, b, starts, ends, h, counts in _words(batch.column(0)):
                symbols, size, _ = model.symbols(b, starts, ends, h, words, *words.find(h))
                per = np.bincount(np.repeat(np.arange(len(counts)), counts), size, len(counts)).astype(np.int64)
                n, loss = model.learn(adam, symbols, per, lambda t: top * min(1.0, t / 20), np.random.default_rng((turn, part)))
                seen, part, lost = seen + n, part + 1, lost + loss
            # parts of a sum: what is added up over the batches is the last weights times all targets
            return np.append(adam.w.astype(float) * seen - before, (seen - already, lost))

        return learn

    return start


def _score(told, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, log, whole, ends_counted = told.value
        for batch in batches:
            n = batch.num_rows
            score, base, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            many, rare, alone = np.zeros(n, np.int64), [np.empty(0, np.int64)], [np.empty(0)]
            for first, b, starts, ends, h, counts in _words(batch.column(at)):
                m = len(counts)
                doc = np.repeat(np.arange(m), counts)
                place, found = words.find(h)
                plain = np.full(len(h), log(0) if whole else np.nan)
                plain[found] = log(words.count[place[found]])
                score[first:first + m], value = model.score(*model.symbols(b, starts, ends, h, words, place, found), counts, plain, float(log(ends_counted)))
                base[first:first + m] = np.bincount(doc[found], plain[found], m)
                tokens[first:first + m] = counts
                known[first:first + m] = np.bincount(doc[found], minlength=m)
                if whole:
                    # every counted word is at hand, so the others have no count
                    base[first:first + m] += np.bincount(doc[~found], minlength=m) * log(0)
                else:
                    many[first:first + m] = np.bincount(doc[~found], minlength=m)
                    rare.append(h[~found].view(np.int64))
                    alone.append(value[~found])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(rare)), pa.array(np.concatenate(alone))], ["h", "v"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), listed],
                                             [*(x for i, x in enumerate(batch.schema.names) if i != at), "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


class _Log:
    """log10 of (c + 0.5) / (N + 0.5 (V + 1))."""

    def __init__(self, total: int, distinct: int):
        self.low = np.log10(total + 0.5 * (distinct + 1))

    def __call__(self, c):
        return np.log10(np.asarray(c, float) + 0.5) - self.low


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """h, c, word (bytes, with a blank before it) of every word of the texts, and the end token's number without a word."""
    return scratch(train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "h long, c long, word binary").groupBy("h", "word").agg(F.sum("c").alias("c")))


def _totals(counts: DataFrame) -> tuple[int, int, int]:
    """(tokens, distinct tokens, ends) counted."""
    zero = F.lit(0)
    return tuple(counts.agg(F.coalesce(F.sum("c"), zero), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), zero)).first())


def frequent_words(counts: DataFrame, model: Model, frequent: int = FREQUENT) -> Words:
    """The words with the least count that at most `frequent` words reach, to an eighth of a doubling."""
    counts = counts.where("word is not null")
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    left, least = frequent, 1 << 30
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    top = counts.where(step >= least).select("h", "c", "word").toArrow().combine_chunks()
    keys, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    words = top.column("word").combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.binary())
    return Words(keys[order], c[order], *model.speller.spell(*_column(words)), model) if len(order) else Words(keys, c, np.empty(0, np.int64), np.empty(0, np.int64), model)


def fit(train: DataFrame, tokenizer: str, fit_documents: int = FIT_DOCUMENTS, text_col: str = "text", steps: int = STEPS, counts: DataFrame | None = None) -> Model:
    """The attention model, learned from all texts; tokenizer: a file of ranks; counts: `word_counts` of train, if at hand."""
    context, counts = train.sparkSession.sparkContext, word_counts(train, text_col) if counts is None else counts
    speller = Speller(tokenizer)
    ids = counts.where("word is not null").select("c", "word").mapInArrow(_id_counts(context.broadcast(speller)), "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    count, texts = np.zeros(speller.vocabulary), _totals(counts)[2]
    count[ids.column("id").to_numpy()] = ids.column("c").to_numpy()
    model = Model(speller, count, texts)
    if not texts:
        return model
    words = frequent_words(counts, model)
    rows = train.select(F.col(text_col).cast("string").alias("text"))
    # a common start for all tasks: some texts by hash, several times
    share = int(min(1.0, fit_documents / texts) * (1 << 20))
    told = context.broadcast((model, words))
    some = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < share).mapInArrow(_sample(told), "symbols array<int>").toArrow().column(0)
    some = sorted((np.asarray(x.values, np.int64) for x in some if len(x.values)), key=lambda x: x.tobytes())
    adam, g = Adam(model.net), np.random.default_rng(5)
    if some and steps:
        s, y, w = stretches(np.concatenate(some), np.array([len(x) for x in some]), model.net.n, 2 * model.net.block)
        for t in range(1, steps + 1):
            k = g.integers(0, len(s), BATCH // 2)
            adam.step(s[k], y[k], w[k], RATE * min(1.0, t / 50))
        del s, y, w
    model.put(adam.w)
    # then every text once, dealt to rounds by hash; after each round the tasks' weights are averaged by their targets
    for turn, top in enumerate(ROUNDS):
        told = context.broadcast((model, words))
        part = rows.where(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(len(ROUNDS))) == turn)
        total = vector_sum(part, len(adam.w) + 2, _learn(told, top, turn))
        if total[-2]:
            model.put(total[:-2] / total[-2])
            model.losses.append(float(total[-1] / total[-2]))
        model.targets += int(total[-2])
    return model


def score(docs: DataFrame, train: DataFrame, model: Model, keep: list[str], text_col: str = "text", frequent: int = FREQUENT, counts: DataFrame | None = None) -> DataFrame:
    """The columns to keep, n_tokens, n_known, train_tokens, base_score and score of every row of docs; the counts are those of train (counts: its `word_counts`, if at hand)."""
    counts = word_counts(train, text_col) if counts is None else counts
    total, distinct, ends = _totals(counts)
    log, words = _Log(total, distinct), frequent_words(counts, model, frequent)
    whole = len(words.keys) + (ends > 0) == distinct
    told = docs.sparkSession.sparkContext.broadcast((model, words, log, whole, ends))
    schema = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in keep)
    src = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), F.col(text_col).cast("string").alias("__text"))
    done = src.mapInArrow(_score(told, len(keep) + 1), f"{schema}, __row long, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,v:double>>")
    more, mixed, some = F.lit(0.0), F.lit(0.0), F.lit(0).cast("long")
    if not whole:
        done = scratch(done)
        value = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(float(log.low))
        high = F.greatest("v", value)
        both = high + F.log10(WEIGHT * F.pow(F.lit(10.0), F.col("v") - high) + (1 - WEIGHT) * F.pow(F.lit(10.0), value - high))
        sums = (done.select("__row", F.inline("rare")).join(counts.where("word is not null").select("h", "c"), "h", "left").groupBy("__row")
                .agg(F.sum(value).alias("__more"), F.sum(both).alias("__mixed"), F.count("c").alias("__some")))
        done = done.join(sums, "__row", "left")
        more, mixed, some = F.coalesce("__more", F.lit(0.0)), F.coalesce("__mixed", F.lit(0.0)), F.coalesce("__some", F.lit(0))
    known = F.col("n_known") + some + F.lit(1 if ends else 0)
    return done.select(*keep, (F.col("n_tokens") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                       (F.col("base_score") + more + F.lit(float(log(ends)))).alias("base_score"), (F.col("score") + mixed).alias("score"))
