"""Boosted trees on binned features: leaf-wise growth from gradient histograms that Spark sums.

Rows are binned once and stay in memory as blocks of arrays. A round fits one tree per class to the softmax gradient. A scan sums histograms (gradient, hessian, rows per node, feature and
bin) for all open nodes of all the round's trees together, so a round needs as many scans as its trees are deep, whatever the number of leaves and classes. Trees grow leaf by leaf, the
largest gain first: a node is opened ahead of its turn when no more than `max_leaves` nodes of larger gain are known, and of all opened nodes those that the strict order reaches stay.
Scores travel with the rows; the blocks are written anew every `CUT` rounds, so that a lost executor repeats only a few of them. A task holds histograms of at most `PER_SCAN` numbers; they
are dealt by node, added and split there, so the driver sees one split per node and the trees. A node of at most `IN_TASK` rows sends its rows instead, and the task that gets them grows all
that can follow below it; so a round ends in the scan after its nodes have become that small. The scans are jobs on blocks, which need no query planning.

A table of at most `IN_TASK` rows and `AT_HAND` bins is sent to all tasks once instead. The scores then stay on the driver; a round sends each class's probabilities to the task that grows its
tree, and gets the tree and the rows' places in it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scratch import scratch, written

SKETCH = 10_000  # accuracy of the quantiles behind bin edges
CUT = 25  # rounds between two written tables
PER_SCAN = 1 << 22  # numbers summed by one scan
PER_TASK = 2_048  # rows below which a scan is not dealt to more tasks
IN_TASK = 1 << 17  # rows of a node that one task grows to its end
AT_HAND = 1 << 24  # bins of a table that every task may hold
BY_FEATURE = 3_000  # rows from which a histogram is made feature by feature
DIFFERENCE = 1 << 14  # rows of a node whose histogram may be what its sibling's leaves of its parent's
LEAST_HESSIAN = 1e-3
HEAD = 4  # loss and rows of the held part, loss and rows of the rest
BLOCK = "x binary, y binary, held binary"
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins, class, held back, scores


@dataclass
class Tree:
    """Nodes as arrays; `feature` is -1 in a leaf. A row goes left when its bin is at most `cut`, or by `missing_left` when it has no value."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray, missing: int) -> np.ndarray:
        """The node where each row of bins ends."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        rows = rows[self.feature[at] >= 0]
        while len(rows):
            node = at[rows]
            v = x[rows, self.feature[node]]
            at[rows] = np.where(np.where(v == missing, self.missing_left[node], v <= self.cut[node]), self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at


@dataclass
class Model:
    """Bin edges per feature, class names, first scores, trees per round and class, losses of the held part before each round."""

    features: list[str]
    classes: list[str]
    edges: list[np.ndarray]
    bins: int
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)


@dataclass
class _Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


@dataclass
class _Node:
    sums: np.ndarray  # gradient, hessian, rows
    seen: bool = False  # its histogram is known
    split: _Split | None = None
    children: tuple[int, int] | None = None


def best_split(hist: np.ndarray, min_leaf: int, l2: float) -> _Split | None:
    """The split of largest gain from one node's histogram (features x bins and one for missing values x gradient, hessian, rows); None if none gains. Ties go to
    the smaller feature, then the smaller bin."""
    total, missing = hist[0].sum(axis=0), hist[:, -1]
    below = np.cumsum(np.moveaxis(hist[:, :-1], -1, 0), axis=2)
    # sums, features, bins, side of the missing; without missing values both sides are alike and the first is taken
    sides = (0.0, missing.T[:, :, None]) if missing[:, 2].any() else (0.0,)
    left = np.stack([below + s for s in sides], axis=3)
    right = total[:, None, None, None] - left

    def score(s: np.ndarray) -> np.ndarray:
        return s[0] ** 2 / (s[1] + l2)

    fine = (np.minimum(left[2], right[2]) >= min_leaf - 0.5) & (np.minimum(left[1], right[1]) >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, score(left) + score(right) - score(total), -np.inf)
    f, b, m = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, b, m] > 1e-12:
        return None
    a, z = left[:, f, b, m], right[:, f, b, m]
    # a feature without missing values in the node sends later ones to the larger side
    to_left = bool(m) if missing[f, 2] > 0 else bool(a[2] > z[2])
    return _Split(float(gain[f, b, m]), int(f), int(b), to_left, a, z)


class _Growing:
    """One tree while it grows."""

    def __init__(self, max_leaves: int, min_leaf: int, l2: float):
        self.nodes = [_Node(np.zeros(3))]
        self.ends: np.ndarray | None = None  # the rows' nodes in the final tree, where one task has them all
        self.max_leaves, self.min_leaf, self.l2 = max_leaves, min_leaf, l2

    def learn(self, node: int, hist: np.ndarray) -> None:
        n = self.nodes[node]
        n.sums, n.seen, n.split = hist[0].sum(axis=0), True, best_split(hist, self.min_leaf, self.l2)

    def graft(self, node: int, below: _Growing) -> None:
        """A node and all below it, grown elsewhere. Best-first growth takes a part's nodes in the part's own order, so nothing of the final tree is missing there."""
        number = [node, *range(len(self.nodes), len(self.nodes) + len(below.nodes) - 1)]
        for n in below.nodes:
            n.children = n.children and (number[n.children[0]], number[n.children[1]])
        self.ends = below.ends
        self.nodes[node] = below.nodes[0]
        self.nodes += below.nodes[1:]

    def order(self) -> list[int]:
        """The nodes that are split, the largest gain first, as far as histograms are known. A node not yet seen only hides what lies below it; the nodes with larger gains on
        their way stay the same, so every node of the final tree is in this list as soon as it's seen."""
        heap, out = [], []

        def offer(i: int) -> None:
            if self.nodes[i].split is not None:
                heapq.heappush(heap, (-self.nodes[i].split.gain, i))

        offer(0)
        while heap and len(out) < self.max_leaves - 1:
            i = heapq.heappop(heap)[1]
            out.append(i)
            for c in self.nodes[i].children or ():
                offer(c)
        return out

    def wanted(self) -> list[int]:
        """Nodes whose histograms are needed next."""
        if not self.nodes[0].seen:
            return [0]
        found = []
        for i in self.order():
            n = self.nodes[i]
            if n.children is None:
                n.children = (len(self.nodes), len(self.nodes) + 1)
                for s in (n.split.left, n.split.right):
                    # too few rows for two leaves: no histogram can bring a split
                    self.nodes.append(_Node(s, seen=s[2] < 2 * self.min_leaf - 0.5))
            found += [c for c in n.children if not self.nodes[c].seen]
        return found

    def tree(self, split: Sequence[int], rate: float) -> Tree:
        inner, n = set(split), len(self.nodes)
        t = Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n))
        for i, node in enumerate(self.nodes):
            if i in inner:
                s = node.split
                t.feature[i], t.cut[i], t.missing_left[i], (t.left[i], t.right[i]) = s.feature, s.cut, s.missing_left, node.children
            else:
                t.value[i] = -rate * node.sums[0] / (node.sums[1] + self.l2) if node.sums[2] > 0 else 0.0
        return t

    def opened(self) -> Tree:
        """The tree of all opened nodes, to find rows' places in it."""
        return self.tree([i for i, n in enumerate(self.nodes) if n.children is not None], 0.0)

    def final(self, rate: float) -> Tree:
        return self.tree(self.order(), rate)


# ---- rows --------------------------------------------------------------------------------------


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features])


def _edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending bin edges per feature, from mergeable quantile sketches of all training rows in one scan. An edge is within rows / `SKETCH` ranks of its quantile, and exact on
    small tables; on large ones another partitioning may move it by that much."""
    at = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    x = train.select(_values(features).alias("_x"))
    row = x.agg(*[F.expr(f"percentile_approx(_x[{i}], array({at}), {SKETCH}) AS q{i}") for i in range(len(features))]).first()
    return [np.unique(np.asarray(q or [], dtype=float)) for q in row]


def _binned(lists: pa.Array, edges: Sequence[np.ndarray], missing: int) -> np.ndarray:
    x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(lists), len(edges))
    out = np.empty(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], side="left"))
    return out


def _blocks(rows: DataFrame, model: Model, tasks: int) -> RDD:
    """The rows as blocks of arrays, one per Arrow batch, dealt to `tasks` tasks."""
    edges, missing, start, d = model.edges, model.bins, model.start, len(model.edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _binned(b.column("_x"), edges, missing), b.column("_y").to_numpy().astype(np.int32)
                held = b.column("_held").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, held)], ["x", "y", "held"])

    def unpack(r) -> Block:
        y = np.frombuffer(bytes(r["y"]), np.int32)
        return np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, d), y, np.frombuffer(bytes(r["held"]), bool), np.tile(start, (len(y), 1))

    return written(rows.repartition(tasks).mapInArrow(pack, BLOCK), "boosting").rdd.map(unpack)


def _advanced(state: RDD, trees: list[Tree], missing: int) -> RDD:
    """Each row's scores with the values of one round's trees added."""

    def run(block: Block) -> Block:
        x, y, held, raw = block
        raw = raw.copy()
        for j, t in enumerate(trees):
            raw[:, j] += t.value[t.place(x, missing)]
        return x, y, held, raw

    return state.map(run)


def _histogram(x: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """features x bins x (gradient, hessian, rows) of some rows; x: features x rows."""
    d, g, h = len(x), g[rows], h[rows]
    out = np.zeros((3, d * width))
    if len(rows) >= BY_FEATURE:
        by = out.reshape(3, d, width)
        for f in range(d):
            v = x[f][rows].astype(np.intp)
            for i, w in enumerate((g, h, None)):
                by[i, f] = np.bincount(v, w, width)
    else:
        cells = (np.arange(d) * width + x[:, rows].T).ravel()
        for i, w in enumerate((g, h, None)):
            out[i] = np.bincount(cells, None if w is None else np.repeat(w, d), d * width)
    return np.ascontiguousarray(np.moveaxis(out.reshape(3, d, width), 0, -1))


def grown_whole(x: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, max_leaves: int, min_leaf: int, l2: float) -> _Growing:
    """A tree of some of the rows at hand, grown to its end; x: features x rows. A histogram is summed in the order of rows; only a node of more than
    `DIFFERENCE` rows that is the larger of two takes what the smaller one leaves of their parent's."""
    grow, own, hists = _Growing(max_leaves, min_leaf, l2), {0: rows}, {}
    while wanted := set(grow.wanted()):
        if 0 in wanted:
            hists[0] = _histogram(x, rows, g, h, bins + 1)
            grow.learn(0, hists[0])
        for p in [i for i in own if grow.nodes[i].children]:
            s, mine, pair = grow.nodes[p].split, own.pop(p), grow.nodes[p].children
            v = x[s.feature][mine]
            left = np.where(v == bins, s.missing_left, v <= s.cut)
            own[pair[0]], own[pair[1]] = mine[left], mine[~left]
            whole = hists.pop(p)
            least, most = sorted(pair, key=lambda c: len(own[c]))
            if most in wanted and len(own[most]) > DIFFERENCE:
                hists[least] = _histogram(x, own[least], g, h, bins + 1)
                hists[most] = whole - hists[least]
                # no rounding is left in bins without rows
                hists[most][hists[most][..., 2] == 0] = 0
            for c in pair:
                if c in wanted:
                    hists[c] = hists[c] if c in hists else _histogram(x, own[c], g, h, bins + 1)
                    grow.learn(c, hists[c])
    return grow


@dataclass
class _AtHand:
    """A small table: bins (features x rows), classes and marks with every task, scores on the driver."""

    sc: SparkContext
    x: np.ndarray
    y: np.ndarray
    held: np.ndarray
    raw: np.ndarray

    def __post_init__(self) -> None:
        self.shared = self.sc.broadcast((self.x, self.y, self.held))
        self.known: tuple | None = None

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """(losses and rows of both parts, probabilities: classes x rows) at the present scores."""
        if self.known is None:
            e, total, loss = _softmax(self.raw, self.y)
            self.known = np.array([loss[self.held].sum(), self.held.sum(), loss[~self.held].sum(), (~self.held).sum()]), np.ascontiguousarray((e / total[:, None]).T)
        return self.known

    def grown(self, wanted: list[tuple[int, int]], bins: int, max_leaves: int, min_leaf: int, l2: float) -> tuple[np.ndarray, list[_Growing]]:
        head, p = self.state()
        shared = self.shared

        def grow(t: tuple[int, bytes]) -> _Growing:
            (x, y, held), p = shared.value, np.frombuffer(t[1])
            out = grown_whole(x, np.flatnonzero(~held), p - (y == t[0]), p * (1 - p), bins, max_leaves, min_leaf, l2)
            out.ends = out.final(0.0).place(x.T, bins).astype(np.int32)
            return out

        return head, self.sc.parallelize([(j, p[j].tobytes()) for j, _ in wanted], len(wanted)).map(grow).collect()

    def advance(self, trees: list[Tree], ends: list[np.ndarray]) -> None:
        for j, (t, at) in enumerate(zip(trees, ends, strict=True)):
            self.raw[:, j] += t.value[at]
        self.known = None

    def unpersist(self) -> None:
        self.shared.destroy()


def _at_hand(rows: DataFrame, model: Model) -> _AtHand:
    """(_x, _y, _held) in their order."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _binned(b.column(0), edges, missing)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()), *b.columns[1:]], ["x", "_y", "_held"])

    edges, missing, d = model.edges, model.bins, len(model.edges)
    t = rows.mapInArrow(cut, "x binary, _y int, _held boolean").toArrow()
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(-1, d)
    y, held = t.column("_y").to_numpy(), t.column("_held").to_numpy()
    return _AtHand(rows.sparkSession.sparkContext, np.ascontiguousarray(x.T), y, held, np.tile(model.start, (len(y), 1)))


def _softmax(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unnormed probabilities, their sum, loss) of each row."""
    top = raw.max(axis=1, keepdims=True)
    e = np.exp(raw - top)
    total = e.sum(axis=1)
    return e, total, np.log(total) + top[:, 0] - raw[np.arange(len(y)), y]


def _parts(task: int, blocks: Iterator[Block], grown: list[Tree], wanted: list[tuple[int, int]], whole: list[bool], d: int, bins: int) -> Iterator[tuple]:
    """What a task has for a scan: under -1 the losses and rows of both parts, under a (class, node) pair's place in `wanted` the filled cells of its histogram, or bins, gradients and hessians
    of its rows where the pair is one of the `whole`."""
    cells = d * (bins + 1)
    slots, slices = [np.full(len(t.feature), -1) for t in grown], {}
    # the pairs come class by class, so a class has one range of histograms
    summed = [s for s, w in enumerate(whole) if not w]
    for s, (j, node) in enumerate(wanted):
        slots[j][node] = s
    for n, s in enumerate(summed):
        slices[wanted[s][0]] = (slices.get(wanted[s][0], (n, n))[0], n + 1)
    number = np.full(len(wanted), -1)
    number[summed] = np.arange(len(summed))
    column = np.arange(d) * (bins + 1)
    head, hist = np.zeros(HEAD), np.zeros((3, len(summed) * cells))
    for k, (x, y, held, raw) in enumerate(blocks):
        e, total, loss = _softmax(raw, y)
        head += loss[held].sum(), held.sum(), loss[~held].sum(), (~held).sum()
        place = column + x
        for j in sorted({j for j, _ in wanted}):
            slot = np.where(held, -1, slots[j][grown[j].place(x, bins)])
            pj = e[:, j] / total
            g, h = pj - (y == j), pj * (1 - pj)
            for s in np.unique(slot[slot >= 0]).tolist():
                if whole[s]:
                    mine = slot == s
                    yield s, ((task, k), x[mine], (g[mine], h[mine]))
            if j not in slices:
                continue
            lo, hi = slices[j]
            mine = np.flatnonzero((slot >= 0) & (number[slot] >= 0))
            at = ((number[slot[mine]] - lo)[:, None] * cells + place[mine]).ravel()
            part = hist[:, lo * cells:hi * cells]
            for i, w in enumerate((g, h, None)):
                part[i] += np.bincount(at, None if w is None else np.repeat(w[mine], d), minlength=part.shape[1])
    yield -1, ((task, 0), None, head)
    for n, s in enumerate(summed):
        mine = hist[:, n * cells:(n + 1) * cells]
        at = np.flatnonzero(mine[2])
        if len(at):
            yield s, ((task, 0), at.astype(np.int32), mine[:, at])


def _scan(
    state: RDD | _AtHand, grown: list[Tree], wanted: list[tuple[int, int]], whole: list[bool], d: int, bins: int, max_leaves: int, min_leaf: int, l2: float,
) -> tuple[np.ndarray, list[_Growing]]:
    """(losses and rows of both parts, for each wanted (class, node) pair what has grown from it: its split, or all below it if `whole`). Parts of a pair are put together in the order of
    tasks and blocks."""
    if isinstance(state, _AtHand):
        return state.grown(wanted, bins, max_leaves, min_leaf, l2)
    cells = d * (bins + 1)

    def split(found: list[tuple]) -> _Growing:
        total, one = np.zeros((3, cells)), _Growing(max_leaves, min_leaf, l2)
        for _, at, h in found:
            total[:, at] += h
        one.learn(0, np.moveaxis(total.reshape(3, d, bins + 1), 0, -1))
        return one

    def add(parts: Iterator[tuple]) -> Iterator[tuple]:
        got: dict[int, list] = {}
        for s, p in parts:
            got.setdefault(s, []).append(p)
        for s, found in got.items():
            found.sort(key=lambda p: p[0])
            if s < 0:
                yield s, np.sum([h for _, _, h in found], axis=0)
            elif whole[s]:
                x = np.ascontiguousarray(np.concatenate([x for _, x, _ in found]).T)
                yield s, grown_whole(x, np.arange(x.shape[1]), *np.concatenate([np.stack(w) for _, _, w in found], axis=1), bins, max_leaves, min_leaf, l2)
            else:
                yield s, split(found)

    sent = state.mapPartitionsWithIndex(lambda task, blocks: _parts(task, blocks, grown, wanted, whole, d, bins))
    got = dict(sent.partitionBy(min(state.ctx.defaultParallelism, len(wanted) + 1), lambda s: s).mapPartitions(add).collect())
    return got[-1], [got.get(s) or split([]) for s in range(len(wanted))]


# ---- fit and prediction ------------------------------------------------------------------------


def fit(
    train: DataFrame, features: Sequence[str], label: str, rounds: int = 250, rate: float = 0.08, max_leaves: int = 31, min_leaf: int = 50, l2: float = 1.0, bins: int = 64,
    held_share: float = 0.1, patience: int = 20, tolerance: float = 1e-7, seed: int = 20260822, key: str | None = None,
) -> Model:
    """Boosted trees on all rows with a label. A share of the rows, chosen by a hash of `key` (of their values without a key: equal rows then share a side), is held back; growth
    ends after `patience` rounds in which their loss did not fall below its value before them. A class that the hash would hold back whole trains whole; if no row is held, all rounds are
    run. NULL and NaN features are missing values with a learned side. Constant features are never split; with one class every row gets it. No labelled row is an error."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be 2 to 255")
    d = len(features)
    mark = F.col(key).cast("string") if key else _values(features)
    rows = train.select(F.col(label).cast("string").alias("_label"), _values(features).alias("_x"), F.xxhash64(F.lit(seed), mark).alias("_mark")).where("_label IS NOT NULL")
    back = F.pmod("_mark", F.lit(1_000_000)) < int(held_share * 1_000_000)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("_label").agg(F.count("*"), F.count_if(back)).collect()}  # one row per class
    if not counts:
        raise ValueError("no labelled rows")
    classes = sorted(counts)
    shared = [c for c in classes if counts[c][1] < counts[c][0]]
    held = back & F.col("_label").isin(shared)
    share = np.array([n - (h if c in shared else 0) for c, (n, h) in sorted(counts.items())], dtype=float)
    model = Model(list(features), classes, _edges(train.where(F.col(label).isNotNull()), features, bins), bins, np.log(share / share.sum()))
    if len(classes) == 1:
        return model
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_label")).cast("int") - 1
    sc, n = train.sparkSession.sparkContext, sum(c for c, _ in counts.values())
    table = rows.select("_x", code.alias("_y"), held.alias("_held"))
    tasks = min(max(1, -(-n // PER_TASK)), 2 * sc.defaultParallelism)
    state: RDD | _AtHand
    if n <= IN_TASK and n * d <= AT_HAND:
        state = _at_hand(table.repartition(tasks), model)
    else:
        state = _blocks(table, model, tasks).persist(StorageLevel.MEMORY_AND_DISK)
    stale, per = None, max(1, PER_SCAN // (d * (bins + 1) * 3))
    while True:
        growing = [_Growing(max_leaves, min_leaf, l2) for _ in classes]
        first = True
        while wanted := [(j, i) for j, g in enumerate(growing) for i in g.wanted()]:
            grown = [g.opened() for g in growing]
            # the root's rows are counted by the first scan only, but their number is known
            whole = [(growing[j].nodes[i].sums[2] if i else share.sum()) <= IN_TASK for j, i in wanted]
            for a in range(0, len(wanted), per):
                head, found = _scan(state, grown, wanted[a:a + per], whole[a:a + per], d, bins, max_leaves, min_leaf, l2)
                for (j, i), below in zip(wanted[a:a + per], found):
                    growing[j].graft(i, below)
            if first:
                first = False
                if stale is not None:
                    stale.unpersist()
                    stale = None
                if head[1]:
                    model.losses.append(float(head[0] / head[1]))
                if len(model.rounds) == rounds or _settled(model.losses, patience, tolerance):
                    break
        if len(model.rounds) == rounds or _settled(model.losses, patience, tolerance):
            break
        trees = [g.final(rate) for g in growing]
        if all(t.feature[0] < 0 for t in trees):
            break
        model.rounds.append(trees)
        if isinstance(state, _AtHand):
            state.advance(trees, [g.ends for g in growing])
            continue
        moved, stale = _advanced(state, trees, bins), state
        if len(model.rounds) % CUT == 0:
            # written every few rounds, which ends the chain of rounds
            path = scratch(train.sparkSession, "boosting")
            moved.saveAsPickleFile(path)
            moved = sc.pickleFile(path)
        state = moved.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return model


def _settled(losses: Sequence[float], patience: int, tolerance: float) -> bool:
    """None of the last `patience` losses is below the one before them."""
    return len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - tolerance


def predict(df: DataFrame, model: Model, keep: Sequence[str], out: str = "pred") -> DataFrame:
    """The kept columns and the most likely class; ties go to the class that sorts first. The model is sent to all tasks: at most rounds x classes x nodes small numbers."""
    missing, classes = model.bins, np.array(model.classes, dtype=object)
    edges, start, rounds = model.edges, model.start, model.rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _binned(b.column(len(keep)), edges, missing)
            raw = np.tile(start, (len(x), 1))
            for trees in rounds:
                for j, t in enumerate(trees):
                    raw[:, j] += t.value[t.place(x, missing)]
            guess = pa.array(classes[raw.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], guess], [*keep, out])

    rows = df.select(*keep, _values(model.features).alias("__x"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:len(keep)], StructField(out, StringType())]))
