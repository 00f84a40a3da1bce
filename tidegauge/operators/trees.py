"""Trees grown over all executors: boosting of second order, by levels or best leaf first, and extremely random trees.

Rows lie in blocks of numpy columns. What decides about splits are sums over rows (histograms of gradients and Hessians,
ranges, class weights), which every task makes of its blocks and which are added up in a tree of tasks. Their size is
that of nodes x features x bins, whatever the rows; the driver chooses splits and sends the structure back. Margins
stay with the rows. Boosting goes once over the rows for each level of a round, all classes together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.shared import shared_dir

#: Rows of a block, and of a task.
BLOCK, TASK = 8_192, 65_536
#: Rounds of boosting between checkpoints of the margins.
CHECKPOINT = 25
TINY = 1e-12


# trees


@dataclass
class Tree:
    """Nodes in arrays: rows with x <= cut go left, left < 0 is a leaf; cover is the weight that came by in training."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    of_class: int = 0

    def leaf(self, x: np.ndarray) -> np.ndarray:
        return descended(x, self.feature, self.cut, self.left, self.right)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def descended(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node each row ends in."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return node
        goes = x[rows, feature[node]] <= cut[node]
        node = np.where(inner, np.where(goes, left[node], right[node]), node)


@dataclass
class Trees:
    """A fitted set of trees. Boosted ones add to the margins `base`, others are averaged."""

    trees: list[Tree]
    classes: int
    base: list[float] = field(default_factory=list)

    @property
    def boosted(self) -> bool:
        return bool(self.base)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for t in self.trees:
            out[:, t.of_class] += t(x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.boosted:
            return probabilities(self.margins(x))
        return sum((t(x) for t in self.trees), np.zeros((len(x), self.classes))) / len(self.trees)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t.of_class, n, int(t.feature[n]), float(t.cut[n]), int(t.left[n]), int(t.right[n]), np.atleast_1d(t.value[n]).tolist(), float(t.cover[n])) for i, t in enumerate(self.trees) for n in range(len(t.left))]
        spark.createDataFrame([(self.classes, self.base)], "classes long, base array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
        spark.createDataFrame(rows, "tree long, of_class long, node long, feature long, cut double, left long, right long, value array<double>, cover double").coalesce(1 + len(rows) // 200_000).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        facts, nodes = spark.read.parquet(f"{path}/facts").first(), {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            nodes.setdefault(r["tree"], []).append(r)
        base = list(facts["base"])
        value = (lambda v: [x[0] for x in v]) if base else list
        made = [Tree(*(np.array([r[c] for r in n]) for c in ("feature", "cut", "left", "right")), np.array(value([r["value"] for r in n])), np.array([r["cover"] for r in n]), n[0]["of_class"]) for n in nodes.values()]
        return cls(made, facts["classes"], base)


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Of all classes; one margin is the log-odds of the second of two."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
        return np.hstack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# rows in blocks


@dataclass
class Block:
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    margin: np.ndarray | None = None


def blocks(ready: DataFrame, index) -> RDD:
    """Blocks of rows with features (vectors or arrays), a class index, weight and row_id; which rows share a task is a matter of row_id alone."""
    spark = ready.sparkSession
    plain = dict(ready.dtypes)["features"].startswith("array")
    rows = ready.select((F.col("features") if plain else vector_to_array("features")).alias("x"), index.cast("long").alias("y"), F.col("weight").cast("double").alias("weight"), "row_id")
    parts = max(1, math.ceil(rows.count() / TASK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                columns = [part.column("x").flatten(), *(part.column(c) for c in ("y", "weight", "row_id"))]
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in columns], ["x", "y", "weight", "row"])

    packed = rows.repartition(parts, "row_id").sortWithinPartitions("row_id").mapInArrow(pack, "x binary, y binary, weight binary, row binary")

    def unpack(r) -> Block:
        y = np.frombuffer(r["y"], np.int64)
        return Block(np.frombuffer(r["x"], np.float64).reshape(len(y), -1), y, np.frombuffer(r["weight"], np.float64), np.frombuffer(r["row"], np.int64))

    shared_dir(spark)
    return packed.rdd.map(unpack)


def summed(data: RDD, f: Callable[[Block], np.ndarray], merge: Callable = np.add) -> np.ndarray:
    """f of every block, merged in tasks."""

    def part(it: Iterator[Block]) -> Iterator[np.ndarray]:
        total = None
        for b in it:
            one = f(b)
            total = one if total is None else merge(total, one)
        if total is not None:
            yield total

    return data.mapPartitions(part).treeReduce(merge)


def drawn(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, by its id and a seed (mixing of splitmix64)."""
    z = row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


# boosting


@dataclass(frozen=True)
class Boost:
    """How trees are boosted. Hessians of softmax are multiplied by `curvature` (of K classes, if None, by K / (K - 1))."""

    rounds: int = 300
    rate: float = 0.03
    depth: int = 4
    leaves: int | None = None
    subsample: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 256
    curvature: float | None = 2.0

    def shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0)

    def score(self, g, h):
        return np.divide(self.shrunk(g) ** 2, h + self.l2, out=np.zeros_like(g), where=h + self.l2 > TINY)

    def value(self, g: float, h: float) -> float:
        return float(-self.rate * self.shrunk(g) / (h + self.l2)) if h + self.l2 > TINY else 0.0

    def gains(self, sums: np.ndarray) -> np.ndarray:
        """For each feature and bin what a split behind it gains; sums: gradients, Hessians, rows by feature and bin."""
        left = np.cumsum(sums, axis=1)
        total = left[:, -1:]
        right = total - left
        gain = 0.5 * (self.score(left[..., 0], left[..., 1]) + self.score(right[..., 0], right[..., 1]) - self.score(total[..., 0], total[..., 1]))
        fits = (np.minimum(left[..., 1], right[..., 1]) >= self.least_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= max(1, self.least_rows))
        return np.where(fits, gain, -np.inf)


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, curvature: float | None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log-loss by the margins."""
    if margin.shape[1] == 1:
        p = probabilities(margin)[:, 1:]
        g, h = p - (y == 1)[:, None], p * (1 - p)
    else:
        k = margin.shape[1]
        p = probabilities(margin)
        g, h = p - (y[:, None] == np.arange(k)), (k / (k - 1) if curvature is None else curvature) * p * (1 - p)
    return g * weight[:, None], np.maximum(h, 1e-16) * weight[:, None]


class _Growing:
    """A tree on bins while it grows. Every leaf that could be split has its children prepared before they are needed."""

    def __init__(self, how: Boost, allowed: np.ndarray) -> None:
        self.how, self.allowed = how, allowed
        self.feature, self.bin, self.left, self.right, self.depth = [0], [0], [-1], [-1], [0]
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int]] = {}
        self.total: dict[int, np.ndarray] = {}
        self.heap: list[tuple[float, int]] = []
        self.real: dict[int, tuple[int, int]] = {}
        self.n_leaves, self.most = 1, how.leaves or 2**how.depth

    def learned(self, node: int, sums: np.ndarray) -> None:
        self.sums[node], self.total[node] = sums, sums[0].sum(axis=0)
        if self.how.depth >= 0 and self.depth[node] >= self.how.depth:
            return
        gain = np.where(self.allowed[:, None], self.how.gains(sums), -np.inf)
        at = int(np.argmax(gain))
        if gain.flat[at] > TINY:
            self.best[node] = (float(gain.flat[at]), *divmod(at, gain.shape[1]))

    def wanted(self) -> list[int]:
        """Nodes whose sums are to be made: the root, or the smaller child of each leaf in the heap."""
        if not self.total:
            return [0]
        out = []
        for _, node in self.heap:
            if self.left[node] < 0:
                _, f, b = self.best[node]
                self.feature[node], self.bin[node] = f, b
                self.left[node], self.right[node] = len(self.left), len(self.left) + 1
                for _ in range(2):
                    for column, value in ((self.feature, 0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1)):
                        column.append(value)
                rows = np.cumsum(self.sums[node][f, :, 2])
                out.append(self.left[node] if 2 * rows[b] <= rows[-1] else self.right[node])
        return out

    def told(self, nodes: list[int], sums: np.ndarray) -> None:
        if nodes == [0]:
            self.learned(0, sums[0])
            self._push(0)
            return
        parent = {c: p for p in range(len(self.left)) if self.left[p] >= 0 for c in (self.left[p], self.right[p])}
        for node, own in zip(nodes, sums, strict=True):
            p = parent[node]
            other = self.left[p] + self.right[p] - node
            self.learned(node, own)
            self.learned(other, self.sums[p] - own)

    def _push(self, node: int) -> None:
        if node in self.best:
            heapq.heappush(self.heap, (-self.best[node][0], node))

    def advance(self) -> bool:
        """Splits the best leaves as far as their children are known; whether more sums are needed."""
        while self.heap and self.n_leaves < self.most:
            node = self.heap[0][1]
            if self.left[node] < 0:
                return True
            heapq.heappop(self.heap)
            self.real[node] = (self.left[node], self.right[node])
            self.n_leaves += 1
            for child in self.real[node]:
                self._push(child)
            self.sums.pop(node)
        return False

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.left, self.right))

    def tree(self, cuts: list[np.ndarray], of_class: int) -> Tree:
        order, place = [0], {0: 0}
        for node in order:
            for child in self.real.get(node, ()):
                place[child] = len(order)
                order.append(child)
        split = [n in self.real for n in order]
        return Tree(
            np.array([self.feature[n] if s else 0 for n, s in zip(order, split, strict=True)]),
            np.array([cuts[self.feature[n]][self.bin[n]] if s else 0.0 for n, s in zip(order, split, strict=True)]),
            *(np.array([place[self.real[n][side]] if s else -1 for n, s in zip(order, split, strict=True)]) for side in (0, 1)),
            np.array([0.0 if s else self.how.value(*self.total[n][:2]) for n, s in zip(order, split, strict=True)]),
            np.array([self.total[n][1] for n in order]),
            of_class,
        )


def _histograms(b: Block, structures: list, nodes: list[list[int]], n_bins: int, curvature: float | None, keep: tuple[float, int]) -> np.ndarray:
    """Sums of gradients, Hessians and rows by wanted node, feature and bin."""
    g, h = gradients(b.margin, b.y, b.weight, curvature)
    inside = drawn(b.row, keep[1]) < keep[0]
    n_features = b.x.shape[1]
    out = []
    for k, (structure, wanted) in enumerate(zip(structures, nodes, strict=True)):
        if not wanted:
            continue
        at = np.full(len(structure[0]), -1)
        at[wanted] = np.arange(len(wanted))
        own = at[descended(b.x, *structure)]
        rows = np.flatnonzero((own >= 0) & inside)
        flat = ((own[rows, None] * n_features + np.arange(n_features)) * n_bins + b.x[rows]).ravel()
        size = len(wanted) * n_features * n_bins
        each = [np.bincount(flat, np.repeat(v[rows], n_features), size) for v in (g[:, k], h[:, k])] + [np.bincount(flat, minlength=size).astype(float)]
        out.append(np.stack(each, axis=1).reshape(len(wanted), n_features, n_bins, 3))
    return np.concatenate(out)


def cut_points(ready: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Of each feature the greatest values of all bins but the last: its quantiles."""
    x = vector_to_array("features")
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = ready.select(x.alias("x")).agg(*(F.percentile_approx(F.col("x")[i], shares, F.lit(10_000)).alias(f"q{i}") for i in range(n_features)), *(F.max(F.col("x")[i]).alias(f"m{i}") for i in range(n_features))).first()
    return [np.array(sorted({v for v in found[f"q{i}"] or [] if v < found[f"m{i}"]})) for i in range(n_features)]


def boosted(ready: DataFrame, index, n_classes: int, how: Boost, seed: int) -> Trees:
    """Boosted trees; two classes have one margin, more have one each and a tree a round on shared probabilities."""
    weights = {r["y"]: r["w"] for r in ready.groupBy(index.cast("long").alias("y")).agg(F.sum("weight").alias("w")).collect()}
    share = np.maximum(np.array([weights.get(k, 0.0) for k in range(n_classes)]), TINY) / max(sum(weights.values()), TINY)
    base = [float(np.log(share[1] / share[0]))] if n_classes == 2 else np.log(share).tolist()
    raw = blocks(ready, index)
    n_features = len(ready.select("features").first()[0])
    cuts = cut_points(ready, n_features, how.bins)
    n_bins = max(len(c) for c in cuts) + 1

    def binned(b: Block) -> Block:
        x = np.stack([np.searchsorted(c, b.x[:, i]) for i, c in enumerate(cuts)], axis=1)
        return Block(x.astype(np.int32), b.y, b.weight, b.row, np.tile(np.array(base), (len(b.y), 1)))

    state, made, old = raw.map(binned).persist(StorageLevel.MEMORY_AND_DISK), [], None
    random = np.random.default_rng(seed)
    for r in range(how.rounds):
        growing = []
        for _ in base:
            allowed = np.zeros(n_features, bool)
            allowed[random.permutation(n_features)[: max(1, math.ceil(how.columns * n_features - TINY))]] = True
            growing.append(_Growing(how, allowed))
        need = [True] * len(growing)
        while any(need):
            nodes = [t.wanted() if n else [] for t, n in zip(growing, need, strict=True)]
            structures, keep, curvature = [t.arrays() for t in growing], (how.subsample, seed * 1_000_003 + r), how.curvature
            sums = summed(state, lambda b, s=structures, n=nodes, k=keep: _histograms(b, s, n, n_bins, curvature, k))
            if old is not None:
                old.unpersist()
                old = None
            start = 0
            for t, own in zip(growing, nodes, strict=True):
                if own:
                    t.told(own, sums[start : start + len(own)])
                    start += len(own)
            need = [t.advance() for t in growing]
        round_ = [t.tree(cuts, k) for k, t in enumerate(growing)]
        made += round_
        if r + 1 == how.rounds or all(len(t.left) == 1 and not t.value.any() for t in round_):
            break
        # with bins for values a row goes where its bin goes
        steps = [Tree(t.feature, np.array([np.searchsorted(cuts[f], c) for f, c in zip(t.feature, t.cut, strict=True)]), t.left, t.right, t.value, t.cover) for t in round_]

        def moved(b: Block, steps=steps) -> Block:
            return Block(b.x, b.y, b.weight, b.row, b.margin + np.stack([t(b.x) for t in steps], axis=1))

        old, state = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CHECKPOINT == 0:
            state.checkpoint()
    state.unpersist()
    if old is not None:
        old.unpersist()
    return Trees(made, n_classes, base)


# extremely random trees


@dataclass(frozen=True)
class Random:
    """How random trees grow. features: how many that are not constant in a node are tried there."""

    trees: int = 300
    depth: int = 6
    least_rows: int = 20
    features: int = 1
    #: Trees that grow side by side, which bounds what tasks send.
    together: int = 64


def tried(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, n: int) -> list[tuple[int, float]]:
    """Features of a node and a cut for each, uniform between its least and greatest value there. node: 1 for the root, 2 n and 2 n + 1 below."""
    random = np.random.default_rng([seed, tree, node])
    order, share = random.permutation(len(low)), random.random(len(low))
    out = []
    for f in order:
        if high[f] > low[f] and len(out) < n:
            cut = low[f] + share[f] * (high[f] - low[f])
            out.append((int(f), float(low[f] if cut >= high[f] else cut)))
    return out


def gini_gain(left: np.ndarray, total: np.ndarray) -> float:
    """By how much a split lowers the weighted impurity; class weights of the left part and of all."""
    right = total - left
    of = lambda w: w.sum() - (w**2).sum() / w.sum() if w.sum() > 0 else 0.0
    return float(of(total) - of(left) - of(right))


class _Scattered:
    """One random tree while it grows, level by level."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.path = [0], [0.0], [-1], [-1], [1]
        self.total: list[np.ndarray | None] = [None]
        self.open = [0]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)

    def split(self, node: int, feature: int, cut: float, left: np.ndarray) -> list[int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.left), len(self.left) + 1
        for side, total in enumerate((left, self.total[node] - left)):
            for column, value in ((self.feature, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.path, 2 * self.path[node] + side), (self.total, total)):
                column.append(value)
        return [self.left[node], self.right[node]]

    def tree(self) -> Tree:
        weights = np.array([t[:-1] for t in self.total])
        return Tree(*self.arrays(), weights / weights.sum(axis=1, keepdims=True), weights.sum(axis=1))


def _where(b: Block, structure: tuple, wanted: list[int]) -> np.ndarray:
    at = np.full(len(structure[0]), -1)
    at[wanted] = np.arange(len(wanted))
    return at[descended(b.x, *structure)]


def _ranges(b: Block, structures: list, nodes: list[list[int]]) -> np.ndarray:
    """Least values, and greatest ones negated, of the features in each node."""
    out = []
    for structure, wanted in zip(structures, nodes, strict=True):
        own = np.full((len(wanted), 2, b.x.shape[1]), np.inf)
        at = _where(b, structure, wanted)
        order = np.argsort(at, kind="stable")
        order = order[at[order] >= 0]
        if len(order):
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            own[at[order][starts], 0] = np.minimum.reduceat(b.x[order], starts)
            own[at[order][starts], 1] = -np.maximum.reduceat(b.x[order], starts)
        out.append(own)
    return np.concatenate(out)


def _lefts(b: Block, structures: list, nodes: list[list[int]], tries: list[list[list[tuple[int, float]]]], most: int, classes: int) -> np.ndarray:
    """Class weights and rows on the left of each cut tried; of a node without cuts those of all its rows."""
    out = []
    for structure, wanted, cuts in zip(structures, nodes, tries, strict=True):
        at = _where(b, structure, wanted)
        own = np.zeros((len(wanted), most, classes + 1))
        for j in range(most):
            feature = np.array([c[j][0] if j < len(c) else 0 for c in cuts])
            cut = np.array([c[j][1] if j < len(c) else (np.inf if not c and j == 0 else -np.inf) for c in cuts])
            rows = np.flatnonzero(at >= 0)
            rows = rows[b.x[rows, feature[at[rows]]] <= cut[at[rows]]]
            own[:, j, :classes] = np.bincount(at[rows] * classes + b.y[rows], b.weight[rows], len(wanted) * classes).reshape(-1, classes)
            own[:, j, classes] = np.bincount(at[rows], minlength=len(wanted))
        out.append(own)
    return np.concatenate(out)


def scattered(ready: DataFrame, index, n_classes: int, how: Random, seed: int) -> Trees:
    """Extremely random trees: all rows in each, one uniform cut for a feature, the best of the features tried."""
    data = blocks(ready, index).persist(StorageLevel.MEMORY_AND_DISK)
    made: list[Tree] = []
    for first in range(0, how.trees, how.together):
        group = [_Scattered() for _ in range(min(how.together, how.trees - first))]
        totals = summed(data, lambda b: _lefts(b, [(np.zeros(1, int), np.zeros(1), -np.ones(1, int), -np.ones(1, int))], [[0]], [[[]]], 1, n_classes))[0, 0]
        for t in group:
            t.total[0] = totals
        for _ in range(how.depth):
            live = [(i, t) for i, t in enumerate(group) if t.open]
            if not live:
                break
            structures, nodes = [t.arrays() for _, t in live], [t.open for _, t in live]
            ranges = summed(data, lambda b, s=structures, n=nodes: _ranges(b, s, n), np.minimum)
            tries, at = [], 0
            for i, t in live:
                tries.append([tried(seed, first + i, t.path[n], ranges[at + j, 0], -ranges[at + j, 1], how.features) for j, n in enumerate(t.open)])
                at += len(t.open)
            lefts = summed(data, lambda b, s=structures, n=nodes, c=tries: _lefts(b, s, n, c, how.features, n_classes))
            at = 0
            for (_, t), cuts in zip(live, tries, strict=True):
                further: list[int] = []
                for j, node in enumerate(t.open):
                    total, best = t.total[node], (TINY, None)
                    for k, (f, cut) in enumerate(cuts[j]):
                        left = lefts[at + j, k]
                        if min(left[-1], total[-1] - left[-1]) >= how.least_rows:
                            gain = gini_gain(left[:-1], total[:-1])
                            best = (gain, (f, cut, left)) if gain > best[0] else best
                    if best[1]:
                        further += [n for n in t.split(node, *best[1]) if t.total[n][-1] >= 2 * how.least_rows and np.count_nonzero(t.total[n][:-1]) > 1]
                at += len(t.open)
                t.open = further
        made += [t.tree() for t in group]
    data.unpersist()
    return Trees(made, n_classes)
