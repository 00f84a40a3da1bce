"""Recurrent and attention nets over windows of bars, trained by gradients that tasks sum.

A net is a function of its parameters and a batch of windows, written with the few differentiable steps below; running
them keeps what the way back needs, through all bars of a window. Every step of training is one job: each task adds up
the gradients of its rows of the batch, the sum is clipped, and the driver moves the parameters, which are all it
holds. Which rows make a batch is a matter of their ids, so that tasks and executors do not change what is learned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.sql import SparkSession

from tidegauge.operators.trees import Block, drawn, summed

#: Steps of an epoch at most: batches grow with the rows, as each step is a job.
STEPS = 64


# differentiable steps


class Value:
    """An array and, once told, what the loss changes by each of its elements."""

    __slots__ = ("array", "grad", "sources")

    def __init__(self, array: np.ndarray, *sources: tuple[Value, Callable]) -> None:
        self.array, self.grad, self.sources = array, None, sources

    def __add__(self, other: Value) -> Value:
        return Value(self.array + other.array, (self, lambda g: _like(g, self.array)), (other, lambda g: _like(g, other.array)))

    def __mul__(self, other: Value) -> Value:
        return Value(self.array * other.array, (self, lambda g: _like(g * other.array, self.array)), (other, lambda g: _like(g * self.array, other.array)))

    def __matmul__(self, other: Value) -> Value:
        return Value(self.array @ other.array, (self, lambda g: _like(g @ other.array.swapaxes(-1, -2), self.array)), (other, lambda g: _like(self.array.swapaxes(-1, -2) @ g, other.array)))

    def __getitem__(self, at) -> Value:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.array)
            out[at] = g
            return out

        return Value(self.array[at], (self, back))

    def scaled(self, by) -> Value:
        return Value(self.array * by, (self, lambda g: g * by))

    def sigmoid(self) -> Value:
        y = 1 / (1 + np.exp(-np.clip(self.array, -500, 500)))
        return Value(y, (self, lambda g: g * y * (1 - y)))

    def tanh(self) -> Value:
        y = np.tanh(self.array)
        return Value(y, (self, lambda g: g * (1 - y * y)))

    def relu(self) -> Value:
        return Value(np.maximum(self.array, 0), (self, lambda g: g * (self.array > 0)))

    def shaped(self, *shape: int) -> Value:
        return Value(self.array.reshape(shape), (self, lambda g: g.reshape(self.array.shape)))

    def turned(self, *axes: int) -> Value:
        return Value(self.array.transpose(axes), (self, lambda g: g.transpose(np.argsort(axes))))

    def softmax(self) -> Value:
        e = np.exp(self.array - self.array.max(axis=-1, keepdims=True))
        y = e / e.sum(axis=-1, keepdims=True)
        return Value(y, (self, lambda g: y * (g - (g * y).sum(axis=-1, keepdims=True))))

    def normed(self, eps: float = 1e-5) -> Value:
        """Mean 0 and variance 1 along the last axis."""
        d = self.array - self.array.mean(axis=-1, keepdims=True)
        s = np.sqrt((d * d).mean(axis=-1, keepdims=True) + eps)
        y = d / s
        return Value(y, (self, lambda g: (g - g.mean(axis=-1, keepdims=True) - y * (g * y).mean(axis=-1, keepdims=True)) / s))


def joined(a: Value, b: Value) -> Value:
    n = a.array.shape[-1]
    return Value(np.concatenate([a.array, b.array], axis=-1), (a, lambda g: g[..., :n]), (b, lambda g: g[..., n:]))


def _like(g: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A gradient summed over the axes along which an array was spread."""
    while g.ndim > a.ndim:
        g = g.sum(axis=0)
    return g.sum(axis=tuple(i for i, n in enumerate(a.shape) if n == 1 and g.shape[i] != 1), keepdims=True) if g.shape != a.shape else g


def backward(root: Value, grad: np.ndarray) -> None:
    order, seen, todo = [], set(), [(root, False)]
    while todo:
        v, done = todo.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            todo.append((v, True))
            todo += [(s, False) for s, _ in v.sources]
    root.grad = grad
    for v in reversed(order):
        for source, back in v.sources:
            g = back(v.grad)
            source.grad = g if source.grad is None else source.grad + g


# nets


@dataclass(frozen=True)
class Shape:
    """kind: lstm, gru or transformer; size is that of the hidden state, or of a token."""

    kind: str
    bars: int
    features: int
    classes: int
    size: int = 32
    layers: int = 1
    dropout: float = 0.2
    both_ways: bool = False
    heads: int = 4
    causal: bool = True

    def __post_init__(self) -> None:
        if self.kind == "transformer" and self.size % self.heads:
            raise ValueError(f"a token of {self.size} cannot be shared by {self.heads} heads")


def started(s: Shape, seed: int) -> dict[str, np.ndarray]:
    """Parameters to begin with."""
    r, out = np.random.default_rng(seed), {}

    def linear(name: str, n: int, m: int, bound: float) -> None:
        out[f"{name}.w"], out[f"{name}.b"] = r.uniform(-bound, bound, (n, m)), r.uniform(-bound, bound, m)

    def norm(name: str, n: int) -> None:
        out[f"{name}.w"], out[f"{name}.b"] = np.ones(n), np.zeros(n)

    d = s.size
    if s.kind == "transformer":
        linear("proj", s.features, d, 1 / math.sqrt(s.features))
        out["pos"] = np.clip(r.normal(0, 0.02, (s.bars, d)), -0.04, 0.04)
        for k in range(s.layers):
            for name in ("q", "k", "v"):
                linear(f"{k}.{name}", d, d, math.sqrt(6 / (4 * d)))
                out[f"{k}.{name}.b"][:] = 0
            linear(f"{k}.o", d, d, 1 / math.sqrt(d))
            linear(f"{k}.up", d, 4 * d, 1 / math.sqrt(d))
            linear(f"{k}.down", 4 * d, d, 1 / math.sqrt(4 * d))
            norm(f"{k}.n1", d)
            norm(f"{k}.n2", d)
    else:
        gates, ways = (4 if s.kind == "lstm" else 3), ("f", "r") if s.both_ways else ("f",)
        for k in range(s.layers):
            for way in ways:
                linear(f"{k}{way}.x", s.features if k == 0 else d * len(ways), gates * d, 1 / math.sqrt(d))
                linear(f"{k}{way}.h", d, gates * d, 1 / math.sqrt(d))
        d *= len(ways)
    norm("norm", d)
    linear("head", d, s.classes, 1 / math.sqrt(d))
    return out


def run(s: Shape, p: dict[str, Value], x: np.ndarray, random: np.random.Generator | None = None) -> Value:
    """Scores of the classes for windows (rows x bars x features); dropout only where a generator is given."""

    def drop(v: Value) -> Value:
        return v.scaled((random.random(v.array.shape) >= s.dropout) / (1 - s.dropout)) if random is not None and s.dropout else v

    def linear(name: str, v: Value) -> Value:
        return v @ p[f"{name}.w"] + p[f"{name}.b"]

    def norm(name: str, v: Value) -> Value:
        return v.normed() * p[f"{name}.w"] + p[f"{name}.b"]

    last = _attended(s, p, x, linear, norm, drop) if s.kind == "transformer" else _recurred(s, x, linear, drop)
    return linear("head", drop(norm("norm", last)))


def _recurred(s: Shape, x: np.ndarray, linear, drop) -> Value:
    """What the last bar of the last layer says."""
    d, steps, ways = s.size, [Value(x[:, t]) for t in range(s.bars)], ("f", "r") if s.both_ways else ("f",)

    def cell(name: str, v: Value, h: Value, c: Value) -> tuple[Value, Value]:
        a, b = linear(f"{name}.x", v), linear(f"{name}.h", h)
        part = lambda g, i: g[:, i * d : (i + 1) * d]
        if s.kind == "lstm":
            g = a + b
            c = part(g, 1).sigmoid() * c + part(g, 0).sigmoid() * part(g, 2).tanh()
            return part(g, 3).sigmoid() * c.tanh(), c
        r, z = (part(a, 0) + part(b, 0)).sigmoid(), (part(a, 1) + part(b, 1)).sigmoid()
        new = (part(a, 2) + r * part(b, 2)).tanh()
        return new + z * (h + new.scaled(-1.0)), c

    for k in range(s.layers):
        if k:
            steps = [drop(v) for v in steps]
        sides = []
        for way in ways:
            h = c = Value(np.zeros((len(x), d)))
            out = []
            for v in steps if way == "f" else steps[::-1]:
                h, c = cell(f"{k}{way}", v, h, c)
                out.append(h)
            sides.append(out if way == "f" else out[::-1])
        steps = sides[0] if len(sides) == 1 else [joined(a, b) for a, b in zip(*sides, strict=True)]
    return steps[-1]


def _attended(s: Shape, p: dict[str, Value], x: np.ndarray, linear, norm, drop) -> Value:
    """The last token, which has seen all bars of its window; with `causal` none sees those after it."""
    n, d, e = len(x), s.size, s.size // s.heads
    v = linear("proj", Value(x)) + p["pos"]
    ahead = Value(np.triu(np.full((s.bars, s.bars), -1e30), 1) if s.causal else np.zeros((s.bars, s.bars)))
    for k in range(s.layers):
        normed = norm(f"{k}.n1", v)
        q, key, value = (linear(f"{k}.{name}", normed).shaped(n, s.bars, s.heads, e).turned(0, 2, 1, 3) for name in "qkv")
        seen = drop(((q @ key.turned(0, 1, 3, 2)).scaled(1 / math.sqrt(e)) + ahead).softmax()) @ value
        v = v + drop(linear(f"{k}.o", seen.turned(0, 2, 1, 3).shaped(n, s.bars, d)))
        v = v + drop(linear(f"{k}.down", drop(linear(f"{k}.up", norm(f"{k}.n2", v)).relu())))
    return v[:, s.bars - 1]


# training


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(s: dict[str, tuple[int, ...]], values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(s):
        n = math.prod(s[k])
        out[k], at = values[at : at + n].reshape(s[k]), at + n
    return out


def losses(s: Shape, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, random: np.random.Generator | None = None, gradient: bool = True) -> np.ndarray:
    """The summed gradient of the weighted log-loss, that loss, and the weight."""
    values = {k: Value(v) for k, v in p.items()}
    out = run(s, values, x.reshape(len(x), s.bars, s.features), random)
    e = np.exp(out.array - out.array.max(axis=1, keepdims=True))
    share = e / e.sum(axis=1, keepdims=True)
    loss = -(weight * np.log(np.maximum(share[np.arange(len(y)), y], 1e-300))).sum()
    if not gradient:
        return np.array([loss, weight.sum()])
    backward(out, (share - (y[:, None] == np.arange(s.classes))) * weight[:, None])
    return np.r_[flat({k: v.grad if v.grad is not None else np.zeros_like(v.array) for k, v in values.items()}), loss, weight.sum()]


@dataclass
class Net:
    """A fitted net, and how a window's features are filled, centred and scaled."""

    shape: Shape
    params: dict[str, np.ndarray]
    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    history: list[dict] = field(default_factory=list)

    def ready(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), self.shape.bars, self.shape.features)
        x = np.where(np.isnan(x), self.fill, x)
        return np.nan_to_num((x - self.centre) * self.scale).reshape(len(x), -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = run(self.shape, {k: Value(v) for k, v in self.params.items()}, self.ready(x).reshape(len(x), self.shape.bars, self.shape.features)).array
        e = np.exp(out - out.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = self.params | {"/fill": self.fill, "/centre": self.centre, "/scale": self.scale}
        spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in arrays.items()], "name string, shape array<long>, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
        spark.createDataFrame([tuple(vars(self.shape).values())], "kind string, bars long, features long, classes long, size long, layers long, dropout double, both_ways boolean, heads long, causal boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Net:
        arrays = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/arrays").collect()}
        return cls(Shape(**spark.read.parquet(f"{path}/shape").first().asDict()), {k: v for k, v in arrays.items() if k[0] != "/"}, *(arrays[f"/{k}"] for k in ("fill", "centre", "scale")))


@dataclass(frozen=True)
class Training:
    epochs: int = 40
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    patience: int = 6
    seed: int = 42


def trained(s: Shape, train: RDD, n: int, tail: RDD, how: Training, progress: Callable[[str, dict], None] | None = None) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Adam with decoupled decay; the parameters of the epoch with the least loss on the tail, and what each epoch said."""
    params = started(s, how.seed)
    shapes, values = {k: v.shape for k, v in params.items()}, flat(params)
    mean, square, best, least, bad, t = np.zeros_like(values), np.zeros_like(values), values, math.inf, 0, 0
    steps = min(STEPS, max(1, math.ceil(n / how.batch)))
    history: list[dict] = []
    for epoch in range(how.epochs):
        total, weights = 0.0, 0.0
        for step in range(steps):

            def of(b: Block, epoch=epoch, step=step, values=values) -> np.ndarray:
                rows = np.flatnonzero((drawn(b.row, how.seed * 7919 + epoch) * steps).astype(int) == step)
                random = np.random.default_rng([how.seed, epoch, step, int(b.row[0]) & 0xFFFFFFFF])
                return losses(s, unflat(shapes, values), b.x[rows], b.y[rows], b.weight[rows], random) if len(rows) else np.zeros(len(values) + 2)

            told = summed(train, of)
            gradient, loss, weight = told[:-2], told[-2], told[-1]
            total, weights = total + loss, weights + weight
            if weight <= 0:
                continue
            gradient = gradient / weight
            gradient *= min(1.0, 1.0 / (np.linalg.norm(gradient) + 1e-6))
            t += 1
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            values = values * (1 - how.rate * how.decay) - how.rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        told = summed(tail, lambda b, values=values: losses(s, unflat(shapes, values), b.x, b.y, np.ones(len(b.y)), gradient=False))
        val = float(told[0] / told[1])
        history.append({"epoch": epoch + 1, "train_loss": total / max(weights, 1e-12), "val_loss": val, "best_val": min(least, val)})
        if progress:
            progress("epoch", history[-1])
        if val < least - 1e-5:
            least, bad, best = val, 0, values
        else:
            bad += 1
            if bad >= how.patience:
                break
    return unflat(shapes, best), history
