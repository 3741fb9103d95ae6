"""Many clustering fits in shared passes: each scan of the rows moves all fits that are not finished.

A fit has a number of clusters, a seed and, where the rows carry an array of weights, the place of its weight in it (bootstrap replicates, fixed subsamples). The
number of scans is that of the slowest fit, not their sum. k-means starts by oversampling: two rounds draw 2k rows a fit, each row with a chance in
proportion to its weighted squared distance from the rows drawn so far, then weighted k-means++ brings them down to k. Draws are hashes of (seed, round,
row), so they're the same on every partitioning and retry. Mixtures start from a k-means fit of their own.

A task holds the centres (or components) of the unfinished fits and one block of distances; it sends their sums, and they are added as a tree. Rows of at most `IN_TASK` numbers are sent to
all tasks instead, and the fits are dealt out: a task moves its fits to their end with the same steps, without a job for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import Centres, Mixture
from .linear import dimension, distances, matrix
from .partials import vector_sum

CELLS = 1 << 21  # numbers in a block of rows x centres
NEAREST = 1 << 18  # such numbers while the nearest centres are found
BLOCK = 1 << 19  # numbers in a block of rows x products of coordinates
SPLITS = 4  # input splits per task, at most
IN_TASK = 1 << 23  # numbers of all rows (coordinates and weights) that every task may hold
TURNS = 4  # groups of k-means fits per core
MIXED = 2  # groups of mixtures per core, whose components share products of the rows
LOSS = 1e-8  # error of a log density beyond which it is not taken from products
ROUNDS = 2


@dataclass(frozen=True)
class Fit:
    k: int
    seed: int
    weight: int | None = None


def prepared(df: DataFrame, key: str | None, vec: str, weights: str | None = None) -> DataFrame:
    """(vec, _h[, weights]) as the fits read it: `_h` names the row in draws, by its key or else by its place. The rows are dealt evenly, however few files or row groups
    they come from: a task per core, more only for more than `SPLITS` input splits a core, so that the sums which tasks send don't multiply with the input."""
    name = F.monotonically_increasing_id() if key is None else F.col(key)
    cols = [F.transform(vec, lambda x: x.cast("double")).alias("_v"), F.xxhash64(name).alias("_h")]
    rows = df.select(*cols, *([F.col(weights).cast("array<double>").alias("_w")] if weights else []))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, -(-df.rdd.getNumPartitions() // (SPLITS * cores))), "_h")


def _weights(b: pa.RecordBatch, fits: Sequence[Fit]) -> np.ndarray | None:
    """fits x rows; None if all weigh one."""
    if all(f.weight is None for f in fits):
        return None
    return _chosen(np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1).T, fits)


def _chosen(w: np.ndarray, fits: Sequence[Fit]) -> np.ndarray:
    return np.stack([np.ones(w.shape[1]) if f.weight is None else w[f.weight] for f in fits])


def _slices(n: int, width: int, cells: int) -> Iterator[slice]:
    step = max(1, cells // max(1, width))
    for lo in range(0, n, step):
        yield slice(lo, lo + step)


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """A block that is used again and again: fresh memory costs more than the products written to it."""
    n = int(np.prod(shape))
    if name not in _rooms or not n <= len(_rooms[name]) <= 4 * n + CELLS:
        _rooms[name] = np.empty(n)
    return _rooms[name][:n].reshape(shape)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


class Stack:
    """The centres of several fits, and the nearest one of each fit. Fits with as many centres stand together, all their first centres, then all second ones and so on, so that whole blocks
    are compared."""

    def __init__(self, centres: Sequence[np.ndarray]):
        self.sizes = np.array([len(c) for c in centres])
        self.start = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(int)
        self.all = np.concatenate(centres)
        self.place = np.empty(len(self.all), int)  # of a centre in that order
        self.groups, at = [], 0
        for k in np.unique(self.sizes).tolist():
            fits = np.flatnonzero(self.sizes == k)
            for j in range(k):
                self.place[self.start[fits] + j] = at + j * len(fits) + np.arange(len(fits))
            self.groups.append((fits, k, at))
            at += k * len(fits)
        order = np.argsort(self.place)
        self.turned = np.concatenate((-2 * self.all, (self.all**2).sum(axis=1)[:, None]), axis=1)[order]

    def _apart(self, one: np.ndarray) -> np.ndarray:
        """Squared distances less the squared lengths of the rows (with a one each), centres (in the order of blocks) x rows."""
        return np.matmul(self.turned, one.T, out=_room("apart", len(self.turned), len(one)))

    def choice(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of its centres, squared distance) for the nearest one, fits x rows; the first centre on ties."""
        d = self._apart(_with_one(x))
        best, far = np.empty((len(self.sizes), len(x)), np.int32), np.empty((len(self.sizes), len(x)))
        for fits, k, at in self.groups:
            m = len(fits)
            low, which = d[at:at + m], np.zeros((m, len(x)), np.int32)
            for j in range(1, k):
                other = d[at + j * m:at + (j + 1) * m]
                np.copyto(which, j, where=other < low)
                np.minimum(low, other, out=low)
            best[fits], far[fits] = which, low
        far += (x**2).sum(axis=1)
        return best, np.maximum(far, 0, out=far)

    def member(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a one each: (1 for a row's nearest centre of a fit and else 0, centres in the order of blocks x rows; squared distance, fits x rows)."""
        d, far = self._apart(one), np.empty((len(self.sizes), len(one)))
        out = _room("member", *d.shape)
        for fits, k, at in self.groups:
            block = slice(at, at + k * len(fits))
            near = d[block].reshape(k, len(fits), -1)
            low, mine = near[0].copy(), out[block].reshape(near.shape)
            for other in near[1:]:
                np.minimum(low, other, out=low)
            np.equal(near, low, out=mine)
            if mine.sum() != low.size:
                # ties: the first centre has the row
                first = near.argmin(axis=0)
                for j in range(k):
                    np.equal(first, j, out=mine[j])
            far[fits] = low
        far += (one[:, :-1]**2).sum(axis=1)
        return out, np.maximum(far, 0, out=far)

    def weighed(self, member: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        if w is not None:
            for fits, k, at in self.groups:
                member[at:at + k * len(fits)].reshape(k, len(fits), -1)[:] *= w[fits]
        return member


def _uniform(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1] per row."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) ^ (np.uint64(seed & ((1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1) * np.uint64(0xD1B54A32D192ED03))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def _drawn(best: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, h: np.ndarray, w: np.ndarray | None, fits: Sequence[Fit], stack: Stack | None, counts: Sequence[int], turn: int) -> None:
    """Merges rows into the draws so far: of each fit the counts[i] first (times, rows), when each row waits for an exponential time whose rate is its weight x squared distance."""
    for at in _slices(len(x), len(stack.all) if stack else len(fits), NEAREST):
        rate = stack.choice(x[at])[1] if stack else np.ones((len(fits), len(x[at])))
        rate = rate if w is None else rate * w[:, at]
        for i, f in enumerate(fits):
            ok = np.flatnonzero(rate[i] > 0)
            if len(ok):
                t, n = -np.log(_uniform(h[at][ok], f.seed, turn)) / rate[i, ok], counts[i]
                if len(t) > n:
                    near = np.flatnonzero(t <= np.partition(t, n - 1)[n - 1])
                    ok, t = ok[near], t[near]
                best[i] = _first(np.concatenate((best[i][0], t)), np.concatenate((best[i][1], x[at][ok])), n)


def _first(t: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.lexsort((*x.T[:1], t))[:n]
    return t[first], x[first]


def _placed(x: np.ndarray, w: np.ndarray | None, stack: Stack) -> np.ndarray:
    """Weight of the rows nearest to each centre of the stack."""
    total = np.zeros(len(stack.all))
    for at in _slices(len(x), len(stack.all), NEAREST):
        own = stack.choice(x[at])[0] + stack.start[:, None]
        total += np.bincount(own.reshape(-1), None if w is None else w[:, at].reshape(-1), len(stack.all))
    return total


def _moved(x: np.ndarray, w: np.ndarray | None, stack: Stack) -> np.ndarray:
    """Sums and weights of each cluster's rows, and each fit's cost, as one vector."""
    dim = x.shape[1]
    total, cost = np.zeros((len(stack.all), dim + 1)), np.zeros(len(stack.sizes))
    for at in _slices(len(x), len(stack.all), NEAREST):
        one = _with_one(x[at])
        member, far = stack.member(one)
        own = None if w is None else w[:, at]
        total += np.matmul(stack.weighed(member, own), one, out=_room("sums", *total.shape))
        cost += (far if own is None else far * own).sum(axis=1)
    total = total[stack.place]
    return np.concatenate((total[:, :dim].reshape(-1), total[:, dim], cost))


def _products(y: np.ndarray) -> np.ndarray:
    """Per row the products of two coordinates (one triangle, row by row), the coordinates, and one; products x rows."""
    n, dim = y.shape
    out, at, t = _room("products", dim * (dim + 1) // 2 + dim + 1, n), 0, np.ascontiguousarray(y.T)
    for i in range(dim):
        np.multiply(t[i], t[i:], out=out[at:at + dim - i])
        at += dim - i
    out[at:-1], out[-1] = t, 1
    return out


class _Densities:
    """The components of several mixtures, as factors of `_products`: one matrix product gives the log densities of rows under all of them. It loses digits where a component is narrow for the
    rows' distance from 0 (their mean); such a component's are taken from whitened differences."""

    def __init__(self, models: Sequence[tuple], shift: np.ndarray):
        self.sizes = np.array([len(m[0]) for m in models])
        weights, self.means = np.concatenate([m[0] for m in models]), np.concatenate([m[1] for m in models]) - shift
        chol = np.concatenate([m[2] for m in models])
        dim = len(shift)
        self.inner = np.linalg.inv(chol).transpose(0, 2, 1)
        self.level = np.log(weights) - np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1) - 0.5 * dim * np.log(2 * np.pi)
        a = self.inner @ self.inner.transpose(0, 2, 1)
        upper = np.triu_indices(dim)
        line = np.einsum("kij,kj->ki", a, self.means)
        self.steep = np.trace(a, axis1=1, axis2=2)
        self.factor = np.concatenate((a[:, upper[0], upper[1]] * np.where(upper[0] == upper[1], -0.5, -1.0), line, (self.level - 0.5 * (line * self.means).sum(axis=1))[:, None]), axis=1)

    def log_density(self, y: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Components x rows."""
        out = np.matmul(self.factor, products, out=_room("density", len(self.factor), len(y)))
        for j in np.flatnonzero(np.finfo(float).eps * self.steep * (y * y).sum(axis=1).max() > LOSS):
            z = (y - self.means[j]) @ self.inner[j]
            out[j] = self.level[j] - 0.5 * (z * z).sum(axis=1)
        return out


def _expected(y: np.ndarray, w: np.ndarray | None, ready: _Densities | Stack) -> np.ndarray:
    """Sums of `_products` by the components' shares, then log likelihood and weight of all rows by fit, as one vector. Rows belong to the nearest centre of a stack."""
    dim, fits = y.shape[1], len(ready.sizes)
    width = dim * (dim + 1) // 2 + dim + 1
    begin = np.concatenate(([0], np.cumsum(ready.sizes)))
    total, ll = np.zeros((begin[-1], width)), np.zeros(fits)
    for at in _slices(len(y), max(width, begin[-1]), BLOCK):
        v, own = y[at], None if w is None else w[:, at]
        products = _products(v)
        if isinstance(ready, Stack):
            share = ready.weighed(ready.member(_with_one(v))[0], own)[ready.place]
        else:
            share = ready.log_density(v, products)
            for i, (lo, hi) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                part = share[lo:hi]
                top = part.max(axis=0)
                part -= top
                np.exp(part, out=part)
                every = part.sum(axis=0)
                part *= (1.0 if own is None else own[i]) / every
                lse = top + np.log(every)
                ll[i] += lse.sum() if own is None else lse @ own[i]
        total += np.matmul(share, products.T, out=_room("sums", *total.shape))
    return np.concatenate((total.reshape(-1), ll, np.full(fits, float(len(y))) if w is None else w.sum(axis=1)))


class Scans:
    """`prepared` rows whose sums come from scans."""

    def __init__(self, data: DataFrame, dim: int):
        self.data, self.dim, self.sc = data, dim, data.sparkSession.sparkContext

    def draw(self, fits: Sequence[Fit], stack: Stack | None, counts: Sequence[int], turn: int) -> list[np.ndarray]:
        """counts[i] rows for fit i, drawn without replacement by weight x squared distance from its centres in the stack (by weight alone without one). A task sends its first counts[i]."""
        dim, shared = self.dim, self.sc.broadcast((list(fits), stack, list(counts)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fits, stack, counts = shared.value
            best = [(np.empty(0), np.empty((0, dim)))] * len(fits)
            for b in batches:
                if b.num_rows:
                    _drawn(best, matrix(b.column(0), dim), b.column(1).to_numpy(), _weights(b, fits), fits, stack, counts, turn)
            for i, (t, x) in enumerate(best):
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["fit", "t", "x"])

        def merge(table: pa.Table) -> pa.Table:
            i = table.column("fit")[0].as_py()
            t = np.concatenate([np.frombuffer(v.as_py()) for v in table.column("t")])
            x = np.concatenate([np.frombuffer(v.as_py()).reshape(-1, dim) for v in table.column("x")])
            t, x = _first(t, x, shared.value[2][i])
            return pa.table({"fit": table.column("fit")[:1], "t": pa.array([t.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

        schema = "fit long, t binary, x binary"
        out = [np.empty((0, dim))] * len(fits)
        for r in self.data.mapInArrow(run, schema).groupBy("fit").applyInArrow(merge, schema).toArrow().to_pylist():
            out[r["fit"]] = np.frombuffer(r["x"]).reshape(-1, dim)
        return out

    def _sum(self, size: int, fits: Sequence[Fit], ready: Callable, part: Callable) -> np.ndarray:
        """Sum over all rows of part(rows, weights, what ready makes of the broadcast) in each task."""
        dim, fits = self.dim, list(fits)

        def start():
            made = ready()
            return lambda b: part(matrix(b.column(0), dim), _weights(b, fits), made)

        return vector_sum(self.data, size, start)

    def placed(self, fits: Sequence[Fit], stack: Stack) -> np.ndarray:
        shared = self.sc.broadcast(stack)
        return self._sum(len(stack.all), fits, lambda: shared.value, _placed)

    def moved(self, fits: Sequence[Fit], stack: Stack) -> np.ndarray:
        shared = self.sc.broadcast(stack)
        return self._sum(len(stack.all) * (self.dim + 1) + len(fits), fits, lambda: shared.value, _moved)

    def expected(self, fits: Sequence[Fit], models: Sequence, shift: np.ndarray) -> np.ndarray:
        shared, size = self.sc.broadcast(list(models)), self.dim * (self.dim + 1) // 2 + self.dim + 1
        return self._sum(sum(f.k for f in fits) * size + 2 * len(fits), fits, lambda: _ready(shared.value, shift), lambda x, w, made: _expected(x - shift, w, made))


def _ready(models: Sequence, shift: np.ndarray) -> _Densities | Stack:
    return _Densities(models, shift) if isinstance(models[0], tuple) else Stack([m - shift for m in models])


@dataclass(frozen=True)
class Rows:
    """All of the `prepared` rows at hand, in the order of their names; weights x rows."""

    x: np.ndarray
    h: np.ndarray
    w: np.ndarray | None

    @property
    def dim(self) -> int:
        return self.x.shape[1]

    def _own(self, fits: Sequence[Fit]) -> np.ndarray | None:
        return None if all(f.weight is None for f in fits) else _chosen(self.w, fits)

    def draw(self, fits: Sequence[Fit], stack: Stack | None, counts: Sequence[int], turn: int) -> list[np.ndarray]:
        best = [(np.empty(0), np.empty((0, self.dim)))] * len(fits)
        _drawn(best, self.x, self.h, self._own(fits), fits, stack, counts, turn)
        return [x for _, x in best]

    def placed(self, fits: Sequence[Fit], stack: Stack) -> np.ndarray:
        return _placed(self.x, self._own(fits), stack)

    def moved(self, fits: Sequence[Fit], stack: Stack) -> np.ndarray:
        return _moved(self.x, self._own(fits), stack)

    def expected(self, fits: Sequence[Fit], models: Sequence, shift: np.ndarray) -> np.ndarray:
        return _expected(self.x - shift, self._own(fits), _ready(models, shift))


def _held(data: DataFrame, dim: int, fits: Sequence[Fit]) -> Rows | None:
    """The rows, where every task may hold them all."""
    weights = len(data.columns) > 2
    wide = dim + (data.select(F.max(F.size("_w"))).first()[0] or 0 if weights else 0)
    if data.count() * wide > IN_TASK:
        return None
    t = data.toArrow().combine_chunks()
    h = t.column(1).to_numpy()
    order = np.argsort(h, kind="stable")
    w = np.ascontiguousarray(np.asarray(t.column(2).combine_chunks().flatten()).reshape(len(h), -1)[order].T) if weights else None
    if any(f.weight is not None and not (w[f.weight] > 0).any() for f in fits):
        raise ValueError("a fit has no rows with weight")
    return Rows(matrix(t.column(0), dim)[order], h[order], w)


def _dealt(sc: SparkContext, rows: Rows, fits: Sequence[Fit], turns: int, run: Callable[[Rows, list[Fit]], list]) -> list:
    """run of some of the fits in each task, those with many clusters first."""
    order = sorted(range(len(fits)), key=lambda i: -fits[i].k)
    done = np.cumsum([fits[i].k for i in order])
    tasks = (done - 1) * min(len(fits), turns * sc.defaultParallelism) // done[-1]
    parts = [[i for i, t in zip(order, tasks.tolist(), strict=True) if t == task] for task in np.unique(tasks).tolist()]
    shared, fits = sc.broadcast(rows), list(fits)
    out: list = [None] * len(fits)
    for part, found in sc.parallelize([(p, [fits[i] for i in p]) for p in parts], len(parts)).map(lambda t: (t[0], run(shared.value, t[1]))).collect():
        for i, model in zip(part, found, strict=True):
            out[i] = model
    return out


def _reduce(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over a few candidates, then a few iterations: k centres, or as many as there are different candidates."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, k])
    centres = points[[int(rng.choice(len(points), p=weight / weight.sum()))]]
    far = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and (far * weight).sum() > 0:
        p = far * weight
        centres = np.concatenate((centres, points[[int(rng.choice(len(points), p=p / p.sum()))]]))
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(10):
        best = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.bincount(best, weight, len(centres))
        sums = np.stack([np.bincount(best, weight * c, len(centres)) for c in points.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.where(total > 0, total, 1)[:, None], centres)
    return centres


def starts(data: DataFrame, dim: int, fits: Sequence[Fit]) -> list[np.ndarray]:
    """Start centres of every fit in ROUNDS + 2 scans."""
    return _starts(Scans(data, dim), fits)


def _starts(rows: Scans | Rows, fits: Sequence[Fit]) -> list[np.ndarray]:
    chosen = rows.draw(fits, None, [1] * len(fits), 0)
    if any(not len(c) for c in chosen):
        raise ValueError("a fit has no rows with weight")
    for turn in range(1, ROUNDS + 1):
        more = rows.draw(fits, Stack(chosen), [2 * f.k for f in fits], turn)
        chosen = [np.concatenate(p) for p in zip(chosen, more, strict=True)]
    stack = Stack(chosen)
    weight = rows.placed(fits, stack)
    cut = [weight[s:s + n] for s, n in zip(stack.start, stack.sizes, strict=True)]
    return [_reduce(c, w, f.k, f.seed) for c, w, f in zip(chosen, cut, fits, strict=True)]


def kmeans(data: DataFrame, fits: Sequence[Fit], max_iter: int = 300, tolerance: float = 1e-4) -> list[Centres]:
    """All fits over `prepared` rows. A fit is finished when no centre moves by more than `tolerance`; its cost is that of its last assignment. An emptied cluster
    keeps its centre."""
    dim = dimension(data, "_v")
    if (rows := _held(data, dim, fits)) is None:
        return _kmeans(Scans(data, dim), fits, max_iter, tolerance)
    return _dealt(data.sparkSession.sparkContext, rows, fits, TURNS, lambda rows, some: _kmeans(rows, some, max_iter, tolerance))


def _kmeans(rows: Scans | Rows, fits: Sequence[Fit], max_iter: int, tolerance: float) -> list[Centres]:
    now = _starts(rows, fits)
    cost = [float("nan")] * len(fits)
    active = list(range(len(fits)))
    for _ in range(max_iter):
        sums, n, paid = _moments(rows, [fits[i] for i in active], [now[i] for i in active])
        left = []
        for i, s, c, p in zip(active, sums, n, paid, strict=True):
            moved = np.where(c[:, None] > 0, s / np.where(c > 0, c, 1)[:, None], now[i])
            shift = np.sqrt(((moved - now[i]) ** 2).sum(axis=1)).max()
            now[i], cost[i] = moved, p
            if shift > tolerance:
                left.append(i)
        active = left
        if not active:
            break
    return [Centres(c, p) for c, p in zip(now, cost, strict=True)]


def moments(data: DataFrame, dim: int, fits: Sequence[Fit], centres: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """One scan: per fit the weighted sums and counts of its clusters' rows and its cost."""
    return _moments(Scans(data, dim), fits, centres)


def _moments(rows: Scans | Rows, fits: Sequence[Fit], centres: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    stack, dim = Stack(centres), rows.dim
    got, width = rows.moved(fits, stack), len(stack.all)
    sums, n, cost = got[:width * dim].reshape(width, dim), got[width * dim:width * (dim + 1)], got[width * (dim + 1):]
    cut = list(zip(stack.start, stack.sizes, strict=True))
    return [sums[s:s + m] for s, m in cut], [n[s:s + m] for s, m in cut], cost.tolist()


def restarts(data: DataFrame, fits: Sequence[Fit], n_init: int, max_iter: int = 300) -> list[Centres]:
    """The cheapest of n_init starts (seeds seed, seed + 1, ...) of every fit, the earliest on ties; all starts share the scans."""
    each = [Fit(f.k, f.seed + i, f.weight) for f in fits for i in range(n_init)]
    found = kmeans(data, each, max_iter)
    return [min(found[lo:lo + n_init], key=lambda c: c.cost) for lo in range(0, len(each), n_init)]


def mixtures(data: DataFrame, fits: Sequence[Fit], max_iter: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6) -> list[Mixture]:
    """Full-covariance mixtures of all fits, from k-means starts. A fit is finished when its mean log likelihood moves less than the tolerance."""
    dim = dimension(data, "_v")
    if (rows := _held(data, dim, fits)) is None:
        return _mixtures(Scans(data, dim), fits, max_iter, tolerance, ridge)
    return _dealt(data.sparkSession.sparkContext, rows, fits, MIXED, lambda rows, some: _mixtures(rows, some, max_iter, tolerance, ridge))


def _mixtures(rows: Scans | Rows, fits: Sequence[Fit], max_iter: int, tolerance: float, ridge: float) -> list[Mixture]:
    dim = rows.dim
    begin = _kmeans(rows, fits, 30, 1e-4)
    # a start with fewer centres than asked for has components without rows, which the ridge keeps finite
    mean = _moments(rows, [Fit(1, 0)], [np.zeros((1, dim))])
    shift = mean[0][0][0] / max(mean[1][0][0], 1.0)
    hard = [np.concatenate((c.values, np.repeat(shift[None], f.k - len(c.values), axis=0))) for c, f in zip(begin, fits, strict=True)]
    mix: list[Mixture | None] = [None] * len(fits)
    last: list[float | None] = [None] * len(fits)
    active = list(range(len(fits)))
    for step in range(max_iter + 1):
        models = [hard[i] if step == 0 else (mix[i].weights, mix[i].means, np.linalg.cholesky(mix[i].covs)) for i in active]
        got = _expect(rows, [fits[i] for i in active], models, shift)
        left = []
        for i, (w, s, ss, ll, n) in zip(active, got, strict=True):
            if step:
                mix[i] = Mixture(mix[i].weights, mix[i].means, mix[i].covs, ll, int(round(n)))
                done = last[i] is not None and abs(ll / n - last[i]) < tolerance or step == max_iter
                last[i] = ll / n
                if done:
                    continue
            safe = w + 10 * np.finfo(float).eps
            rel = s / safe[:, None]
            covs = ss / safe[:, None, None] - rel[:, :, None] * rel[:, None, :] + ridge * np.eye(dim)
            mix[i] = Mixture(safe / safe.sum(), rel + shift, covs, float("nan"), int(round(n)))
            left.append(i)
        active = left
        if not active:
            break
    return mix


def _expect(rows: Scans | Rows, fits: Sequence[Fit], models: Sequence, shift: np.ndarray) -> list[tuple]:
    """Per fit the weights, sums and second moments (around `shift`) of its components, log likelihood and weight of all rows. Of a second moment one triangle travels."""
    dim, k = rows.dim, sum(f.k for f in fits)
    upper = np.triu_indices(dim)
    got = rows.expected(fits, models, shift)
    total, ll, n = got[:-2 * len(fits)].reshape(k, -1), got[-2 * len(fits):-len(fits)], got[-len(fits):]
    out, lo = [], 0
    for i, f in enumerate(fits):
        v = total[lo:lo + f.k]
        full = np.empty((f.k, dim, dim))
        full[:, upper[0], upper[1]] = v[:, :len(upper[0])]
        full[:, upper[1], upper[0]] = v[:, :len(upper[0])]
        out.append((v[:, -1], v[:, len(upper[0]):-1], full, float(ll[i]), float(n[i])))
        lo += f.k
    return out


Model = Centres | Mixture


def labeller(models: Sequence[Model]) -> Callable[[np.ndarray], np.ndarray]:
    """Cluster of each row under each model, rows x models."""
    hard = [i for i, m in enumerate(models) if not hasattr(m, "covs")]
    soft = [i for i, m in enumerate(models) if hasattr(m, "covs")]
    stack = Stack([models[i].values for i in hard]) if hard else None
    if soft:
        shift = models[soft[0]].weights @ models[soft[0]].means
        dense = _Densities([(models[i].weights, models[i].means, np.linalg.cholesky(models[i].covs)) for i in soft], shift)
        begin = np.concatenate(([0], np.cumsum(dense.sizes)))

    def run(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(models)), np.int32)
        if hard:
            for at in _slices(len(x), len(stack.all), NEAREST):
                out[at, hard] = stack.choice(x[at])[0].T
        if soft:
            for at in _slices(len(x), max(dense.factor.shape), BLOCK):
                y = x[at] - shift
                logp = dense.log_density(y, _products(y))
                for i, lo, hi in zip(soft, begin[:-1], begin[1:], strict=True):
                    out[at, i] = logp[lo:hi].argmax(axis=0)
        return out

    return run


def labels(x: np.ndarray, models: Sequence[Model]) -> np.ndarray:
    return labeller(models)(x)


def counts(data: DataFrame, models: Sequence[Model]) -> list[np.ndarray]:
    """Rows of each cluster of each model, in one scan."""
    dim = dimension(data, "_v")
    sizes = [_size(m) for m in models]
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
    shared = data.sparkSession.sparkContext.broadcast(list(models))

    def start():
        label = labeller(shared.value)
        return lambda b: np.bincount((label(matrix(b.column(0), dim)) + begin).reshape(-1), minlength=sum(sizes)).astype(float)

    got = vector_sum(data, sum(sizes), start)
    return [got[s:s + n].astype(np.int64) for s, n in zip(begin, sizes, strict=True)]


def _size(m: Model) -> int:
    return len(m.means) if hasattr(m, "covs") else m.k


def crossings(data: DataFrame, pairs: Sequence[tuple[Model, Model]], weight: Sequence[int | None] | None = None) -> list[np.ndarray]:
    """Contingency table of two models' labels of all rows, for every pair of models, in one scan; `weight` gives a pair's place in the array of weights."""
    dim = dimension(data, "_v")
    known: dict[int, int] = {}
    models: list[Model] = []
    for m in (m for p in pairs for m in p):
        if id(m) not in known:
            known[id(m)] = len(models)
            models.append(m)
    at = [(known[id(a)], known[id(b)]) for a, b in pairs]
    shape = [(_size(a), _size(b)) for a, b in pairs]
    begin = np.concatenate(([0], np.cumsum([a * b for a, b in shape]))).astype(int)
    shared = data.sparkSession.sparkContext.broadcast(models)
    places = [Fit(1, 0, w) for w in (weight or [None] * len(pairs))]

    def start():
        left, right = np.array([a for a, _ in at]), np.array([b for _, b in at])
        width, label = np.array([b for _, b in shape]), labeller(shared.value)

        def part(b: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(begin[-1])
            x, w = matrix(b.column(0), dim), _weights(b, places)
            for at in _slices(len(x), len(pairs), CELLS):
                lab = label(x[at])
                cell = (begin[:-1] + lab[:, left] * width + lab[:, right]).reshape(-1)
                total += np.bincount(cell, None if w is None else w[:, at].T.reshape(-1), begin[-1])
            return total

        return part

    got = vector_sum(data, int(begin[-1]), start)
    return [got[s:s + a * b].reshape(a, b).astype(np.int64) for s, (a, b) in zip(begin[:-1], shape, strict=True)]


def silhouettes(data: DataFrame, models: Sequence[Model], max_rows: int) -> np.ndarray:
    """Mean Euclidean silhouette of every model over all rows, which may be no more than `max_rows` (a fixed subsample, as the study takes): they are sent to all tasks, and each task
    computes its rows' distances to all of them once for all models. NaN where a model has one cluster only."""
    rows = data.select("_v").limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows: take a subsample first")
    dim = dimension(data, "_v")
    every = matrix(rows.column("_v"), dim)
    lab = labels(every, models)
    sizes = np.array([_size(m) for m in models])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
    width = int(sizes.sum())
    n = np.bincount((lab + begin).reshape(-1), minlength=width).astype(float)
    shared = data.sparkSession.sparkContext.broadcast((every, lab, list(models)))

    def start():
        every, lab, models = shared.value
        label = labeller(models)
        member = np.zeros((len(every), width))
        np.put_along_axis(member, lab + begin, 1.0, axis=1)

        def part(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((2, len(models)))
            rows = matrix(b.column(0), dim)
            for at in _slices(len(rows), len(every) + width, CELLS):
                x = rows[at]
                total = distances(x, every) @ member
                own = label(x) + begin
                mine, size = np.take_along_axis(total, own, axis=1), n[own]
                away = np.where(n > 0, total / np.where(n > 0, n, 1), np.inf)
                np.put_along_axis(away, own, np.inf, axis=1)
                other = np.minimum.reduceat(away, begin, axis=1)
                inside = mine / np.maximum(size - 1, 1)
                top = np.maximum(inside, other)
                known = np.isfinite(other)
                s = np.where((size > 1) & (top > 0) & known, (np.where(known, other, 0) - inside) / np.where(known & (top > 0), top, 1), 0.0)
                out[0] += s.sum(axis=0)
                out[1] += known.sum(axis=0)
            return out.reshape(-1)

        return part

    total, known = vector_sum(data, 2 * len(models), start).reshape(2, -1)
    return np.where(known == len(every), total / max(1, len(every)), np.nan)


def adjusted_rand(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table; 1 where both labelings are trivial alike."""
    pairs = lambda n: float((n * (n - 1) // 2).sum())
    cells, a, b = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    n = int(table.sum())
    all_pairs = n * (n - 1) / 2
    chance = a * b / all_pairs if all_pairs else 0.0
    top = (a + b) / 2
    return 1.0 if top == chance else (cells - chance) / (top - chance)
