"""What each feature adds to the score of a row in tree models: Shapley values by the paths to the leaves.

A leaf's value is shared among the features on its path. For each of them the path says whether a row fits all its
conditions (o) and which share of the training weight that reached them went on (z): a feature that is absent from a
coalition is replaced by z. Sums over coalitions of one size are coefficients of a polynomial, so that a leaf costs
the square of its features and no power of two. Trees are bounded by their depth, rows are scored where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.models import KEYS, Ensemble, Logistic, Model, Sequence
from tidegauge.operators.trees import Trees


@dataclass
class Leaf:
    """value, and of each feature on the path: its number, the least (exclusive) and greatest value that fit, and z."""

    value: float
    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray


def leaves(spark: SparkSession, fitted, folder: str, of_class: int) -> list[Leaf]:
    """The leaves of a fitted MLlib forest, read from where it saves itself: shares of a class."""
    fitted.write().overwrite().save(folder)
    trees: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{folder}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    out: list[Leaf] = []
    for nodes in trees.values():
        scale = 1 / len(trees)
        weight = lambda n: sum(n["impurityStats"])
        todo = [(0, {})]
        while todo:
            i, path = todo.pop()
            n = nodes[i]
            if n["leftChild"] < 0:
                value = n["impurityStats"][of_class] / sum(n["impurityStats"])
                f = sorted(path)
                columns = zip(*(path[k] for k in f), strict=True) if f else ((), (), ())
                out.append(Leaf(scale * value, np.array(f, int), *(np.array(c, float) for c in columns)))
                continue
            k, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            low, high, z = path.get(k, (-math.inf, math.inf, 1.0))
            for child, own in ((n["leftChild"], (low, min(high, cut))), (n["rightChild"], (max(low, cut), high))):
                todo.append((child, path | {k: (*own, z * weight(nodes[child]) / weight(n))}))
    return out


def leaves_of(fitted: Trees, of_class: int) -> list[Leaf]:
    """The leaves of trees grown here: of boosted ones those of a class's margin, else shares of the class in each tree's part."""
    out: list[Leaf] = []
    for t in fitted.trees:
        if fitted.boosted and t.of_class != of_class:
            continue
        todo = [(0, {})]
        while todo:
            n, path = todo.pop()
            if t.left[n] < 0:
                f = sorted(path)
                columns = zip(*(path[k] for k in f), strict=True) if f else ((), (), ())
                out.append(Leaf(float(t.value[n]) if fitted.boosted else float(t.value[n][of_class]) / len(fitted.trees), np.array(f, int), *(np.array(c, float) for c in columns)))
                continue
            k, cut = int(t.feature[n]), float(t.cut[n])
            low, high, z = path.get(k, (-math.inf, math.inf, 1.0))
            for child, own in ((t.left[n], (low, min(high, cut))), (t.right[n], (max(low, cut), high))):
                todo.append((child, path | {k: (*own, z * t.cover[child] / t.cover[n])}))
    return out


def shapley(x: np.ndarray, found: list[Leaf]) -> tuple[np.ndarray, float]:
    """What each column adds to the score of each row, and the score of a row of which nothing is known."""
    phi, base = np.zeros(x.shape), 0.0
    for leaf in found:
        m = leaf.feature.size
        base += leaf.value * float(np.prod(leaf.share))
        if not m:
            continue
        fits = ((x[:, leaf.feature] > leaf.above) & (x[:, leaf.feature] <= leaf.upto)).astype(float)
        size = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for j in range(m):
            by_size = np.zeros((len(x), m))  # coalitions of the others by how many they are
            by_size[:, 0] = 1
            for g in range(m):
                if g != j:
                    more = by_size * leaf.share[g]
                    more[:, 1:] += by_size[:, :-1] * fits[:, g : g + 1]
                    by_size = more
            phi[:, leaf.feature[j]] += leaf.value * (by_size @ size) * (fits[:, j] - leaf.share[j])
    return phi, base


def explained(model: Model, rows: DataFrame, folder: str, c: int = 1) -> list[tuple[str, DataFrame]]:
    """For each part of a model that can be explained its name, and instrument, pos, `base` and a value for each feature.

    Forests are explained in the probability of class c, boosted trees and logistic models in its log-odds; so members of
    an ensemble are told apart and never averaged. Models of other kinds have no part here. folder: where trees are saved."""
    if isinstance(model, Ensemble):
        return [(f"{i}.{name}", table) for i, m in enumerate(model.models) for name, table in explained(m, rows, f"{folder}/{i}", c)]
    at = model.classes.index(c) if c in model.classes else len(model.classes) - 1
    if isinstance(model, Sequence):
        return []
    ready = model.prepared(rows)
    name, names = type(model).__name__.lower(), model.names
    if isinstance(model, Logistic):
        fitted = model.fitted[0]
        weights = fitted.coefficients if fitted.numClasses == 2 else fitted.coefficientMatrix.toArray()[at]
        sign = -1.0 if fitted.numClasses == 2 and at == 0 else 1.0
        weights = sign * np.asarray(weights)
        means = ready.select(F.posexplode(_array("features")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
        middle = np.zeros(len(names))
        for r in means:
            middle[r["i"]] = r["m"]
        intercept = fitted.intercept if fitted.numClasses == 2 else fitted.interceptVector[at]
        return [(name, _scored(ready, names, lambda x: ((x - middle) * weights, float(sign * intercept + middle @ weights))))]
    fitted = model.fitted[0]
    if isinstance(fitted, Trees):
        two = fitted.boosted and len(fitted.base) == 1
        found, sign, start = leaves_of(fitted, 0 if two else at), -1.0 if two and at == 0 else 1.0, fitted.base[0 if two else at] if fitted.boosted else 0.0
    elif hasattr(fitted, "treeWeights"):
        found, sign, start = leaves(rows.sparkSession, fitted, folder, at), 1.0, 0.0
    else:
        return []

    def score(x: np.ndarray) -> tuple[np.ndarray, float]:
        phi, base = shapley(x, found)
        return sign * phi, sign * (base + start)

    return [(name, _scored(ready, names, score))]


def _array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


def _scored(ready: DataFrame, names: list[str], score) -> DataFrame:
    kind = dict(ready.dtypes)["instrument"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                phi, base = score(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in KEYS), pa.array(np.full(part.num_rows, base)), *(pa.array(v) for v in phi.T)], [*KEYS, "base", *(f"shap_{n}" for n in names)])

    return ready.select(*KEYS, _array("features").alias("x")).mapInArrow(run, f"instrument {kind}, pos long, base double, " + ", ".join(f"`shap_{n}` double" for n in names))


def importance(values: DataFrame) -> DataFrame:
    """Mean absolute value of each feature."""
    names = [c for c in values.columns if c.startswith("shap_")]
    sums = values.agg(*(F.avg(F.abs(c)).alias(c) for c in names))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c.removeprefix("shap_")).alias("feature"), F.col(c).alias("mean_abs_shap")) for c in names))))
