"""Models: families behind one contract, on MLlib or on sums that tasks make, ensembles, meta-labels, tuning, and the walk through the folds.

A model is fitted on rows with features, label and weight, and gives for other rows the probability of each class it
has seen. Everything it learns, fillings and scales included, comes from its training rows.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import classification, feature
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.functions.shared import shared_dir
from tidegauge.operators import rules
from tidegauge.operators.folds import Fold
from tidegauge.operators.nets import Net, Shape, Training, trained
from tidegauge.operators.trees import Boost, Random, Trees, blocks, boosted, scattered
from tidegauge.operators.tuning import Parzen, Range

CLASSES = (-1, 0, 1)
KEYS = ["instrument", "pos"]
#: Told what is done ("fold", "epoch", "tune") and about it.
Progress = Callable[[str, Any], None] | None


def column_of(c: int) -> str:
    return f"p_{'m1' if c < 0 else c}"


PROBABILITIES = [column_of(c) for c in CLASSES]


class Prepared:
    """Fillings and scales of training rows, and the features as one vector."""

    def __init__(self, train: DataFrame, names: list[str], scaler: str = "standard", imputer: str = "median"):
        self.names = names
        how = {"median": F.median, "mean": F.avg}.get(imputer)
        self.fill = {n: v for n, v in train.agg(*(how(n).alias(n) for n in names)).first().asDict().items() if v is not None} if how else {}
        self.assembler = VectorAssembler(inputCols=names, outputCol="raw_features", handleInvalid="skip")
        self.scaler = None
        if scaler != "none":
            made = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True) if scaler == "standard" else RobustScaler(inputCol="raw_features", outputCol="features", withCentering=True, relativeError=1e-4)
            self.scaler = made.fit(self.assembler.transform(self.filled(train)))

    @classmethod
    def of(cls, names: list[str], fill: dict, scaler) -> Prepared:
        """From what another has learned."""
        out = cls.__new__(cls)
        out.names, out.fill, out.scaler = names, fill, scaler
        out.assembler = VectorAssembler(inputCols=names, outputCol="raw_features", handleInvalid="skip")
        return out

    def filled(self, rows: DataFrame) -> DataFrame:
        """Rows without any feature are left out; gaps are filled with what the training rows say."""
        return rows.where(F.coalesce(*self.names).isNotNull()).fillna(self.fill)

    def __call__(self, rows: DataFrame) -> DataFrame:
        rows = self.assembler.transform(self.filled(rows))
        return self.scaler.transform(rows) if self.scaler else rows.withColumnRenamed("raw_features", "features")


def scored(ready: DataFrame, keep: list[str], names: list[str], f: Callable[[np.ndarray], np.ndarray], vector: str = "features") -> DataFrame:
    """The kept columns and what f makes of the vectors, a column for each name."""
    kinds = dict(ready.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = part.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(c) for c in np.ascontiguousarray(f(x).T))], [*keep, *names])

    x = F.col(vector) if kinds[vector].startswith("array") else vector_to_array(vector)
    return ready.select(*keep, x.alias("__x")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{n}` double" for n in names)]))


def _write_state(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load(spark: SparkSession, path: str) -> Model:
    """A saved model or ensemble."""
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    if "members" in state:
        out = Ensemble(state["families"], state["method"], state["member_params"], state["folds"], seed=state["seed"], scaler=state["scaler"], imputer=state["imputer"])
        out.models = [load(spark, f"{path}/member{i}") for i in range(state["members"])]
        out.names, out.classes = state["names"], state["classes"]
        if out.method == "stacking":
            out.meta, out.meta_names = load(spark, f"{path}/meta"), state["meta_names"]
        return out
    out = family(state["family"], state["params"], state["seed"], state["scaler"], state["imputer"])
    own = {c.__name__: c for c in (Trees, Net)}

    def part(k):
        kind = state["parts"][k]
        return own[kind].load(spark, f"{path}/{k}") if kind in own else getattr(feature if k == "scaled" else classification, kind).load(f"{path}/{k}")

    out.names, out.classes = state["names"], state["classes"]
    out.prepared = Prepared.of(out.names, state["fill"], part("scaled") if "scaled" in state["parts"] else None)
    out.fitted = [part(k) for k in sorted(state["parts"]) if k != "scaled"]
    return out


class Model:
    """A family: how to fit, what can be tuned."""

    search: dict[str, list] = {}

    def __init__(self, params: dict[str, Any] | None = None, seed: int = 42, scaler: str = "standard", imputer: str = "median"):
        self.params, self.seed, self.scaler, self.imputer = dict(params or {}), seed, scaler, imputer

    def classifier(self, weight: float, n_features: int, n_classes: int):
        """MLlib's estimator with the parameters of this family."""
        raise ValueError(f"{type(self).__name__} has no estimator of its own")

    def state(self) -> dict[str, Any]:
        """What a saved model is besides its fitted parts, as JSON can hold it."""
        return {"family": next((k for k, v in FAMILIES.items() if v is type(self)), ""), "params": self.params, "seed": self.seed, "scaler": self.scaler, "imputer": self.imputer, "names": self.names, "classes": self.classes, "fill": self.prepared.fill}

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted model as a folder of MLlib models and one JSON text, in whatever store the path names."""
        parts = {f"fitted{i}": m for i, m in enumerate(self.fitted)} | ({"scaled": self.prepared.scaler} if self.prepared.scaler else {})
        for name, m in parts.items():
            m.save(spark, f"{path}/{name}") if isinstance(m, (Trees, Net)) else m.write().overwrite().save(f"{path}/{name}")
        _write_state(spark, path, self.state() | {"parts": {k: type(m).__name__ for k, m in parts.items()}})

    def windows(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """The rows with what the model reads of the bars before; most read nothing."""
        return rows

    def _labelled(self, train: DataFrame) -> DataFrame:
        """Rows with a label and their weights; notes the classes. Rows without label teach nothing."""
        rows = train.where(F.col("label").isNotNull()).withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in train.columns else F.lit(1.0))
        seen = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
        self.classes = sorted(int(r["label"]) for r in seen)
        if sum(r["n"] for r in seen) < 20 or len(seen) < 2:
            raise ValueError("a model needs 20 labelled rows and two classes")
        if self.params.get("class_weight", "none") != "none":  # every class weighs as much as every other
            each = sum(r["n"] for r in seen) / len(seen)
            share = F.coalesce(*(F.when(F.col("label") == r["label"], F.lit(each / r["n"])) for r in seen))
            rows = rows.withColumn("weight", F.col("weight") * share)
        return rows

    def fit(self, train: DataFrame, names: list[str], progress: Progress = None) -> Model:
        """train has the features, label and weight."""
        rows = self._labelled(train)
        self.names, self.prepared = names, Prepared(rows, names, self.scaler, self.imputer)
        ready = self.prepared(rows).select("features", "label", "weight", F.xxhash64(*KEYS).alias("row_id")).cache()
        total = ready.agg(F.sum("weight")).first()[0]
        try:
            self.fitted = self._fit(ready, total, len(names))
        finally:
            ready.unpersist()
        return self

    def index(self):
        """The place of a row's label among the classes."""
        return F.array_position(F.array(*map(F.lit, self.classes)), F.col("label").cast("int")).cast("double") - 1

    def _fit(self, ready: DataFrame, total: float, n: int) -> list:
        return [self.classifier(total, n, len(self.classes)).setLabelCol("y").fit(ready.withColumn("y", self.index()))]

    def probabilities(self, rows: DataFrame, keep: list[str] = KEYS) -> DataFrame:
        """The kept columns, which name a row, and one of probability for every class; rows that cannot be scored have no row."""
        ready, m = self.prepared(rows), self.fitted[0]
        if isinstance(m, Trees):
            return self._columns(scored(ready, keep, [f"p[{i}]" for i in range(len(self.classes))], m.probabilities), keep)
        return self._columns(m.transform(ready).withColumn("p", vector_to_array("probability")), keep, lambda i: F.col("p")[i])

    def _columns(self, told: DataFrame, keep: list[str], get=lambda i: F.col(f"`p[{i}]`")) -> DataFrame:
        at = {c: i for i, c in enumerate(self.classes)}
        return told.select(*keep, *((get(at[c]) if c in at else F.lit(0.0)).alias(column_of(c)) for c in CLASSES))


class Logistic(Model):
    search = {"C": Range(1e-3, 1e2, log=True), "l1_ratio": [0.0, 0.25, 0.5, 0.75, 1.0]}

    def classifier(self, weight, n_features, n_classes):
        p = self.params
        return LogisticRegression(weightCol="weight", regParam=1 / (p.get("C", 1.0) * weight), elasticNetParam=p.get("l1_ratio", 0.5), maxIter=p.get("max_iter", 100), standardization=False)


class Forest(Model):
    search = {"max_depth": Range(2, 12, whole=True), "min_samples_leaf": [5, 10, 20, 50, 100], "max_features": ["sqrt", "log2", "0.5"]}

    def classifier(self, weight, n_features, n_classes):
        p = self.params
        return RandomForestClassifier(weightCol="weight", numTrees=p.get("n_estimators", 300), maxDepth=min(30, p.get("max_depth", 6)), minInstancesPerNode=p.get("min_samples_leaf", 20), featureSubsetStrategy=p.get("max_features", "sqrt"), seed=self.seed)


class ExtraTrees(Forest):
    """Extremely random trees: all rows in every tree, one uniform cut for each feature that is tried."""

    def how(self, n: int) -> Random:
        p = self.params
        share = {"sqrt": lambda: math.sqrt(n), "log2": lambda: math.log2(n)}.get(p.get("max_features", "sqrt"), lambda: float(p["max_features"]) * n)()
        return Random(p.get("n_estimators", 300), p.get("max_depth", 6), p.get("min_samples_leaf", 20), max(1, int(share)))

    def _fit(self, ready, total, n):
        return [scattered(ready, self.index(), len(self.classes), self.how(n), self.seed)]


class Boosted(Model):
    """Boosting by gradients and Hessians, trees by levels; three classes share their probabilities."""

    search = {"max_depth": Range(2, 8, whole=True), "learning_rate": Range(3e-3, 0.2, log=True), "subsample": Range(0.5, 1.0), "colsample_bytree": Range(0.5, 1.0), "min_child_weight": [1.0, 5.0, 10.0, 20.0], "reg_lambda": Range(0.1, 30.0, log=True)}

    def how(self) -> Boost:
        p = self.params
        return Boost(p.get("n_estimators", 300), p.get("learning_rate", 0.03), p.get("max_depth", 4), None, p.get("subsample", 0.8), p.get("colsample_bytree", 0.8), p.get("reg_alpha", 0.0), p.get("reg_lambda", 1.0), p.get("min_child_weight", 5.0))

    def _fit(self, ready, total, n):
        return [boosted(ready, self.index(), len(self.classes), self.how(), self.seed)]


class Leafwise(Boosted):
    """The same, the leaf of the greatest gain first, up to a number of leaves."""

    search = {"num_leaves": [7, 15, 31, 63], "learning_rate": Range(3e-3, 0.2, log=True), "subsample": Range(0.5, 1.0), "colsample_bytree": Range(0.5, 1.0), "min_child_samples": [10, 20, 50, 100]}

    def how(self) -> Boost:
        p = self.params
        return Boost(p.get("n_estimators", 300), p.get("learning_rate", 0.03), p.get("max_depth", -1), p.get("num_leaves", 15), p.get("subsample", 0.8), p.get("colsample_bytree", 0.8), p.get("reg_alpha", 0.0), p.get("reg_lambda", 0.0), 1e-3, p.get("min_child_samples", 20), 255, None)


class Sequence(Model):
    """A net over the windows of the last `seq_len` bars. Windows to learn from lie within the training rows; rows to score look
    back at the bars before them, where `windows` was called on those too."""

    kind = "lstm"
    search = {"hidden_size": [16, 32, 64, 128], "num_layers": Range(1, 2, whole=True), "dropout": [0.1, 0.2, 0.3, 0.5], "lr": Range(1e-4, 1e-2, log=True)}

    @property
    def bars(self) -> int:
        return self.params.get("seq_len", 20)

    def windows(self, rows, names):
        """A window is null where bars are too few."""
        last = Window.partitionBy("instrument").orderBy("pos").rowsBetween(1 - self.bars, 0)
        made = F.collect_list(F.array(*(F.col(n).cast("double") for n in names))).over(last)
        return rows.withColumn(f"window_{self.bars}", made).withColumn(f"window_{self.bars}", F.expr(f"CASE WHEN size(window_{self.bars}) = {self.bars} THEN flatten(window_{self.bars}) END"))

    def shape(self, n_features: int) -> Shape:
        p = self.params
        return Shape(self.kind, self.bars, n_features, len(self.classes), p.get("hidden_size", 32), p.get("num_layers", 1), p.get("dropout", 0.2), p.get("bidirectional", False))

    def training(self) -> Training:
        p = self.params
        return Training(p.get("epochs", 40), p.get("batch_size", 64), p.get("lr", 1e-3), p.get("weight_decay", 1e-4), p.get("patience", 6), self.seed)

    def fit(self, train, names, progress=None):
        """The tail of the training bars says when to stop; windows that share bars with those before it are in neither part."""
        self.names, column = names, f"window_{self.bars}"
        first = train.agg(F.min("pos")).first()[0]
        rows = self._labelled(train if column in train.columns else self.windows(train, names))
        self.prepared = Prepared(train, names, self.scaler, self.imputer)
        rows = rows.where((F.col("pos") >= first + self.bars - 1) & F.col(column).isNotNull()).select("pos", "label", "weight", F.xxhash64(*KEYS).alias("row_id"), F.col(column).alias("features")).cache()
        n, cut, last = rows.agg(F.count("*"), F.percentile_approx("pos", F.lit(1 - self.params.get("val_fraction", 0.15)), F.lit(10_000)), F.max("pos")).first()
        if n < 50:
            raise ValueError(f"{n} windows of {self.bars} bars are too few")
        begin = cut + self.bars - 1
        early, tail = rows.where(F.col("pos") < cut), rows.where(F.col("pos") >= (begin if begin <= last else cut))
        shape = self.shape(len(names))
        net = Net(shape, {}, *self._scales())
        data = [blocks(part, self.index()).map(lambda b, ready=net.ready: type(b)(ready(b.x), b.y, b.weight, b.row)).persist() for part in (early, tail)]
        net.params, net.history = trained(shape, data[0], early.count(), data[1], self.training(), progress)
        for d in data:
            d.unpersist()
        rows.unpersist()
        self.fitted = [net]
        return self

    def _scales(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fillings, middles, and what to multiply by, of the features."""
        fill, m = np.array([self.prepared.fill.get(n, np.nan) for n in self.names]), self.prepared.scaler
        if m is None:
            return fill, np.zeros(len(fill)), np.ones(len(fill))
        middle, spread = (np.array(v) for v in ((m.mean, m.std) if hasattr(m, "mean") else (m.median, m.range)))
        return fill, middle, np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)

    def probabilities(self, rows, keep=KEYS):
        column = f"window_{self.bars}"
        rows = rows if column in rows.columns else self.windows(rows, self.names)
        made = scored(rows.where(F.col(column).isNotNull()), keep, [f"p[{i}]" for i in range(len(self.classes))], self.fitted[0].probabilities, column)
        return self._columns(made, keep)


class Gru(Sequence):
    kind = "gru"


class Transformer(Sequence):
    kind = "transformer"
    search = {"d_model": [16, 32, 64], "n_layers": Range(1, 3, whole=True), "dropout": [0.1, 0.2, 0.3], "lr": Range(1e-4, 3e-3, log=True)}

    def shape(self, n_features):
        p = self.params
        return Shape(self.kind, self.bars, n_features, len(self.classes), p.get("d_model", 32), p.get("n_layers", 2), p.get("dropout", 0.2), heads=p.get("n_heads", 4), causal=p.get("causal", True))

    def training(self):
        return replace(super().training(), rate=self.params.get("lr", 5e-4))


FAMILIES: dict[str, type[Model]] = {"logreg": Logistic, "random_forest": Forest, "extra_trees": ExtraTrees, "xgboost": Boosted, "lightgbm": Leafwise, "lstm": Sequence, "gru": Gru, "transformer": Transformer}


def family(name: str, params: dict | None = None, seed: int = 42, scaler: str = "standard", imputer: str = "median") -> Model:
    if name not in FAMILIES:
        raise ValueError(f"there is no family {name}; there are {sorted(FAMILIES)}")
    return FAMILIES[name](params, seed=seed, scaler=scaler, imputer=imputer)


# ensembles: members' probabilities side by side


def vote(members: list[DataFrame], method: str = "soft", keep: list[str] = KEYS) -> DataFrame:
    """Mean probability, or share of members whose likeliest class it is, the first of equals; over members that scored the row."""
    each = None
    for m in members:
        if method == "hard":
            top = F.greatest(*PROBABILITIES)
            best = F.coalesce(*(F.when(F.col(p) == top, F.lit(p)) for p in PROBABILITIES))
            m = m.select(*keep, *((best == p).cast("double").alias(p) for p in PROBABILITIES))
        each = m if each is None else each.unionByName(m)
    mean = each.groupBy(*keep).agg(*(F.avg(p).alias(p) for p in PROBABILITIES))
    total = sum(F.col(p) for p in PROBABILITIES)
    return mean.select(*keep, *(F.try_divide(F.col(p), total).alias(p) for p in PROBABILITIES))


class Ensemble(Model):
    """Several families as one: soft or hard votes, or a logistic model over members' probabilities of later blocks."""

    def __init__(self, members: list[str], method: str = "soft", member_params: dict | None = None, folds: int = 4, **how):
        super().__init__({}, **how)
        self.families, self.method, self.member_params, self.n_folds = members, method, member_params or {}, folds

    def save(self, spark, path):
        """Members in folders of their own, and of stacking also the model over them."""
        for i, m in enumerate(self.models):
            m.save(spark, f"{path}/member{i}")
        state = {"members": len(self.models), "families": self.families, "method": self.method, "member_params": self.member_params, "folds": self.n_folds, "seed": self.seed, "scaler": self.scaler, "imputer": self.imputer, "names": self.names, "classes": self.classes}
        if self.method == "stacking":
            self.meta.save(spark, f"{path}/meta")
            state["meta_names"] = self.meta_names
        _write_state(spark, path, state)

    def _members(self) -> list[Model]:
        return [family(f, self.member_params.get(f), self.seed + i, self.scaler, self.imputer) for i, f in enumerate(self.families)]

    def windows(self, rows, names):
        for m in self._members():
            rows = m.windows(rows, names)
        return rows

    def _table(self, models: list[Model], rows: DataFrame, keep: list[str] = KEYS) -> tuple[DataFrame, list[str]]:
        out, names = None, []
        for i, m in enumerate(models):
            p = m.probabilities(rows, keep).select(*keep, *(F.col(c).alias(f"{c}_{i}") for c in PROBABILITIES))
            out = p if out is None else out.join(p, keep)
            names += [f"{c}_{i}" for c in PROBABILITIES]
        return out, names

    def fit(self, train, names, progress=None):
        self.names = names
        if self.method == "stacking":
            lo, hi = train.agg(F.min("pos"), F.max("pos")).first()
            edges = [lo + (hi + 1 - lo) * k // self.n_folds for k in range(self.n_folds + 1)]
            later = None
            for a, b in zip(edges[1:-1], edges[2:], strict=True):
                models = [m.fit(train.where(F.col("pos") < a), names) for m in self._members()]
                p, made = self._table(models, train.where((F.col("pos") >= a) & (F.col("pos") < b)))
                later = p if later is None else later.unionByName(p)
            self.meta_names = made
            keep = [*KEYS, "label", *(["weight"] if "weight" in train.columns else [])]
            self.meta = Logistic(seed=self.seed).fit(later.join(train.select(*keep), KEYS), made)
        self.models = [m.fit(train, names) for m in self._members()]
        self.classes = self.models[0].classes
        return self

    def probabilities(self, rows, keep=KEYS):
        if self.method == "stacking":
            return self.meta.probabilities(self._table(self.models, rows, keep)[0], keep)
        return vote([m.probabilities(rows, keep) for m in self.models], self.method, keep)


# meta-labels


def with_side(rows: DataFrame, rule: str, params: dict | None = None) -> DataFrame:
    """side: what a primary rule does, known at the close of the bar."""
    return Rel(rows).steps(lambda s: {"side": rules.side(s, rule, **(params or {}))}).df


def model_side(primary: Model, train: DataFrame, names: list[str], rows: DataFrame) -> DataFrame:
    """side: what a primary model, fitted on the training rows, thinks likelier; 0 where it cannot tell."""
    told = signals(primary.fit(train, names).probabilities(rows), primary.classes)
    side = told.select(*KEYS, F.signum(F.col("p_long") - F.col("p_short")).cast("int").alias("side"))
    return rows.join(side, KEYS, "left").fillna({"side": 0})


def meta_labels(rows: DataFrame) -> DataFrame:
    """label becomes 1 where the primary side was right and -1 where it was wrong, null where it had none."""
    return rows.withColumn("label", F.when(F.col("side") != 0, F.when(F.col("label") * F.col("side") > 0, 1).when(F.col("label").isNotNull(), -1)))


def meta_signals(probabilities: DataFrame, rows: DataFrame) -> DataFrame:
    """p_trade of the model over the side, and what that says about long and short; 0.5 where the primary has no side."""
    j = rows.select(*KEYS, "side").join(probabilities, KEYS)
    long = F.when(F.col("side") > 0, F.col("p_1")).when(F.col("side") < 0, 1 - F.col("p_1")).otherwise(0.5)
    return j.select(*KEYS, "side", F.when(F.col("side") != 0, F.col("p_1")).alias("p_trade"), long.alias("p_long"), (1 - long).alias("p_short"))


def signals(probabilities: DataFrame, classes: list[int]) -> DataFrame:
    """p_long, p_short, p_neutral and y_pred, the likeliest class; p_short is what p_long leaves where shorts were never seen."""
    top = F.greatest(*PROBABILITIES)
    pred = F.coalesce(*(F.when(F.col(column_of(c)) == top, F.lit(c)) for c in CLASSES if c in classes))
    short = F.col("p_m1") if -1 in classes else 1 - F.col("p_1")
    return probabilities.select(*KEYS, F.col("p_1").alias("p_long"), short.alias("p_short"), F.col("p_0").alias("p_neutral"), pred.alias("y_pred"))


# tuning and walking


def log_loss():
    """Mean log-loss of rows with a label and probabilities."""
    own = F.coalesce(*(F.when(F.col("label") == c, F.col(column_of(c))) for c in CLASSES))
    return F.avg(-F.ln(F.greatest(own, F.lit(1e-15))))


def tuned(make: Callable[[dict], Model], search: dict[str, Range | list], params: dict, train: DataFrame, names: list[str], tries: int, gap: int, seed: int, progress: Progress = None) -> dict:
    """The best settings by log-loss on the last fifth of the training bars, `gap` bars of which are left out in between.

    The given settings are the first trial; what follows a Parzen estimator proposes."""
    lo, hi = train.agg(F.min("pos"), F.max("pos")).first()
    cut = lo + (hi - lo + 1) * 4 // 5
    early, late = train.where(F.col("pos") < cut), train.where((F.col("pos") >= cut + gap) & F.col("label").isNotNull())
    if not search or late.count() < 30:
        return params
    parzen = Parzen(search, seed, min(5, max(1, tries // 3)))
    best, least = params, math.inf
    for k in range(tries):
        asked = {n: params[n] for n in search if n in params} if k == 0 else parzen.ask()
        loss = None
        try:
            p = make(params | asked).fit(early, names).probabilities(late).join(late.select(*KEYS, "label"), KEYS)
            n, loss = p.agg(F.count("*"), log_loss()).first()
            loss = loss if n >= 10 else None
        except ValueError:
            pass
        parzen.tell(asked, math.inf if loss is None else loss)
        if progress:
            progress("tune", {"trial": k, "loss": loss, "params": asked})
        if loss is not None and loss < least:
            best, least = params | asked, loss
    return best


@dataclass
class Walk:
    """Out-of-sample predictions of all folds, and what each fold took."""

    oos: DataFrame
    folds: list[Fold]
    seconds: float
    notes: list[dict] = field(default_factory=list)
    models: dict[int, Model] = field(default_factory=dict)


def build(config, seed: int = 42) -> Model:
    """The model of a ModelConfig."""
    how = {"seed": seed, "scaler": config.scaler, "imputer": config.imputer}
    if config.ensemble.enabled:
        e = config.ensemble
        return Ensemble(e.members, e.method, e.member_params, e.stacking_folds, **how)
    return family(config.family, config.params, **how)


def walk_forward(rows: DataFrame, names: list[str], folds: list[Fold], make: Callable[[], Model], meta: tuple[str, dict] | Callable[[], Model] | None = None, threads: int = 4, tries: int = 0, embargo: int = 5, progress: Progress = None) -> Walk:
    """Fits a model in every fold on bars whose label is known before its test, and predicts that test.

    rows has features, label, t1_pos and weight, and is read for every fold: it should be cached or written. Folds
    run side by side from a few threads. meta: a primary rule and its parameters, or what makes a primary model, which
    each fold fits on its own training rows; the model then learns when the primary is right."""
    began = time.time()
    data = rows
    if meta and not callable(meta):
        data = meta_labels(with_side(rows, *meta))
    data = make().windows(data, names)

    def one(f: Fold) -> tuple[DataFrame, dict, Model]:
        t = time.time()
        inside = (F.col("pos") >= f.train_start) & (F.col("pos") < f.train_end)
        train = data.where(inside & F.col("t1_pos").isNotNull() & (F.col("t1_pos") < f.test_start))
        test = data.where((F.col("pos") >= f.test_start) & (F.col("pos") < f.test_end))
        model = make()
        if callable(meta):
            both = model_side(meta(), train, names, train.withColumn("__train", F.lit(True)).unionByName(test.withColumn("__train", F.lit(False)))).cache()
            train, test = meta_labels(both.where("__train")), both.where("not __train")
        if meta and train.where(F.col("label").isNotNull()).limit(30).count() < 30:
            raise ValueError(f"fold {f.fold_id}: the primary has a side on fewer than 30 training bars")
        if tries and model.search:
            kind = type(model)
            model.params = tuned(lambda p: kind(p, seed=model.seed, scaler=model.scaler, imputer=model.imputer), model.search, model.params, train, names, tries, embargo, model.seed + f.fold_id, progress)
        model.fit(train, names, progress)
        p = model.probabilities(test)
        s = meta_signals(p, test).withColumn("y_pred", F.when(F.col("p_long") > 0.5, 1).otherwise(-1)) if meta else signals(p, model.classes)
        if progress:
            progress("fold", f.fold_id)
        return s.withColumn("fold_id", F.lit(f.fold_id).cast("long")), {"fold_id": f.fold_id, "fit_s": time.time() - t, "params": model.params}, model

    with ThreadPoolExecutor(threads) as pool:
        made = list(pool.map(one, folds))
    oos = made[0][0]
    for p, _, _ in made[1:]:
        oos = oos.unionByName(p)
    if any(b.test_start < a.test_end for a, b in zip(folds, folds[1:], strict=False)):
        raise ValueError("tests overlap; a bar would be predicted twice")
    oos = rows.select("instrument", "ts", "pos", F.col("label").alias("y_true")).join(oos, KEYS)
    return Walk(oos, folds, time.time() - began, [n for _, n, _ in made], {n["fold_id"]: m for _, n, m in made})


def shuffled(rows: DataFrame, names: list[str], folds: list[Fold], seed: int = 0) -> DataFrame:
    """The test rows of all folds, once as they are (feature is empty) and once for each feature with its values shuffled among
    the rows of its fold and instrument: fold_id, feature, and the rows' columns. One exchange for all of them."""
    of_fold = F.coalesce(*(F.when((F.col("pos") >= f.test_start) & (F.col("pos") < f.test_end), F.lit(f.fold_id)) for f in folds)).cast("long")
    tests = rows.withColumn("fold_id", of_fold).where("fold_id is not null")
    copies = tests.withColumn("feature", F.explode(F.array(*(F.lit(n) for n in ("", *names)))))
    value = F.coalesce(*(F.when(F.col("feature") == n, F.struct(F.col(n).cast("double").alias("v"))) for n in names), F.struct(F.lit(None).cast("double").alias("v")))
    group = ["fold_id", "instrument", "feature"]
    w = Window.partitionBy(*group)
    copies = copies.withColumn("__value", value).withColumn("__place", F.row_number().over(w.orderBy("pos"))).withColumn("__other", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", F.col("pos").cast("string"))))))
    moved = copies.where("feature <> ''").select(*group, F.col("__other").alias("__place"), F.col("__value").alias("__moved"))
    mixed = copies.join(moved, [*group, "__place"], "left")
    return mixed.withColumns({n: F.when(F.col("feature") == n, F.col("__moved.v")).otherwise(F.col(n)) for n in names}).drop("__value", "__place", "__other", "__moved")


def permutation_importance(walk: Walk, rows: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
    """How much the log-loss of each fold's test rises when a feature is shuffled among its bars: mean and deviation over folds.

    All rows to score, plain and shuffled, are made once and kept by a checkpoint; then all models score theirs in one job."""
    shared_dir(rows.sparkSession)
    mixed, keep = shuffled(rows, names, walk.folds, seed).checkpoint(), ["fold_id", "feature", *KEYS]
    # one series for each fold and feature, for models that look back at bars before
    apart = mixed.withColumn("instrument", F.concat_ws("|", "feature", "instrument"))
    told = None
    for f in walk.folds:
        one = walk.models[f.fold_id].probabilities(apart.where(F.col("fold_id") == f.fold_id), [*keep, "label"])
        told = one if told is None else told.unionByName(one)
    losses = told.where("label is not null").groupBy("fold_id", "feature").agg(log_loss().alias("loss"))
    plain = losses.where("feature = ''").select("fold_id", F.col("loss").alias("base"))
    rise = losses.where("feature <> ''").join(plain, "fold_id").select("feature", (F.col("loss") - F.col("base")).alias("rise"))
    return rise.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"))
