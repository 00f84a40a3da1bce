"""Mutual information by nearest neighbours against every value compared with every other; where features come from."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import features as ft
from tidegauge.operators import folds as fo
from tidegauge.operators import information as im
from tidegauge.plans import experiment as ex
from tidegauge.plans.config import ExperimentConfig, FeatureConfig, FeatureSpec


def psi(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def plain(x, y, k):
    keep = np.array([np.sum(y == v) > 1 for v in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))
        near = min(k, len(same) - 1)
        r = same[near]
        m = np.sum((np.abs(x - x[i]) < r) | (x == x[i]))
        total += psi(near) - psi(len(same)) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("size", [65_536, 90])
def test_information_is_the_plain_one(spark, size):
    """Values that depend on the label, ties, a value that a third of the rows share, rare labels and one that is there once."""
    r = np.random.default_rng(6)
    n = 1000
    y = r.choice([-1, 0, 1, 5], n, p=[0.45, 0.1, 0.447, 0.003])
    y[0] = 9
    told = {"clear": y * 1.0 + r.normal(size=n) * 0.5, "noise": r.normal(size=n), "ties": np.round(r.normal(size=n) + y * 0.3, 1), "hot": np.where(r.random(n) < 0.35, 0.25, r.random(n))}
    rows = spark.createDataFrame([(*(float(v[i]) for v in told.values()), int(y[i])) for i in range(n)] + [(None, 0.0, 0.0, 0.0, 1), (0.0, 0.0, 0.0, 0.0, None)], "clear double, noise double, ties double, hot double, label int")
    got = {r["feature"]: r["information"] for r in im.nearest(rows, list(told), size=size).collect()}
    assert got == {k: pytest.approx(plain(v, y, 3), abs=1e-9) for k, v in told.items()}
    assert got["clear"] > 0.3 > got["noise"]


def test_digamma(spark):
    got = spark.range(1, 60).select("id", im.digamma(F.col("id")).alias("v")).collect()
    assert all(math.isclose(r["v"], psi(r["id"]), abs_tol=1e-11) for r in got)


def bars(spark, n=300, seed=0):
    close = 100 + np.cumsum(np.random.default_rng(seed).normal(size=n))
    return spark.createDataFrame([("A", i, *[float(close[i])] * 4, 1.0) for i in range(n)], "instrument string, pos long, open double, high double, low double, close double, volume double").selectExpr("instrument", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(pos as int)) as ts", "pos", "open", "high", "low", "close", "volume")


CONFIG = ExperimentConfig(features=FeatureConfig([FeatureSpec("roc", {"window": 3}), FeatureSpec("momentum", {"window": 5})]))


def test_features_say_where_they_come_from(spark):
    b = bars(spark)
    ds = ex.prepare(b, CONFIG)
    told = [ds.rows.schema[n].metadata for n in ds.names]
    assert [(t["shift"], t["feature"]) for t in told] == [(1, "roc"), (1, "momentum")]
    fo.check_provenance(ds.rows.where("pos > 50").orderBy("ts"), ds.names, b)
    with pytest.raises(fo.LeakageError):
        fo.check_provenance(ds.rows, ds.names, bars(spark, seed=1))
    with pytest.raises(fo.LeakageError):
        fo.check_provenance(ds.rows.withColumn(ds.names[0], F.col("close")), ds.names, b)


def test_unshifted_features_are_refused(spark):
    b = bars(spark)
    for wrong in (lambda s, specs: {"now": "close"}, lambda s, specs: ft.matrix(s, specs) | {"now": s.lag("close")}, lambda s, specs: {"now": s.noted("close", shift=0)}):
        with pytest.raises(fo.LeakageError):
            ex.prepare(b, CONFIG, features=wrong)
    ds = ex.prepare(b, CONFIG)
    leaky = ex.Dataset(ds.rows.withColumn("roc_window3", F.col("close")), ds.names, b)
    with pytest.raises(fo.LeakageError):
        ex.walk(leaky, CONFIG)


def test_provenance_survives_files(spark, tmp_path):
    b = bars(spark)
    rows = ft.feature_matrix(b, CONFIG.features.features)
    rows.write.parquet(f"{tmp_path}/rows")
    back = spark.read.parquet(f"{tmp_path}/rows")
    names = [c for c in back.columns if c not in ("instrument", "ts", "pos")]
    fo.check_provenance(back, names, b)
