"""Explanations of trees, saved models, guards, and keys of stages."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.operators import diagnostics as dg
from tidegauge.operators import folds as fo
from tidegauge.operators import metrics as mt
from tidegauge.operators import models as md
from tidegauge.operators import shap as sh
from tidegauge.plans import experiment as ex
from tidegauge.plans.config import BacktestConfig, ExperimentConfig
from tidegauge.sources import runs as rl


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) / 2 > 0, 1, -1)
    return spark.createDataFrame([("A", i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "instrument string, pos long, a double, b double, c double, label int").cache()


def plain_shapley(found, x):
    """By all coalitions: a feature outside of one leaves a leaf with its share of the weight."""

    def score(known):
        total = 0.0
        for leaf in found:
            v = leaf.value
            for k, low, high, share in zip(leaf.feature, leaf.above, leaf.upto, leaf.share, strict=True):
                v *= (low < x[k] <= high) if k in known else share
            total += v
        return total

    n, out = len(x), []
    for j in range(n):
        rest = [k for k in range(n) if k != j]
        out.append(sum(math.factorial(m) * math.factorial(n - 1 - m) / math.factorial(n) * (score({*c, j}) - score(set(c))) for m in range(n) for c in itertools.combinations(rest, m)))
    return out, score(set())


@pytest.mark.parametrize(("family", "params"), [("random_forest", {"n_estimators": 3, "max_depth": 4}), ("xgboost", {"n_estimators": 3, "max_depth": 3}), ("lightgbm", {"n_estimators": 3, "num_leaves": 5}), ("extra_trees", {"n_estimators": 3, "max_depth": 4}), ("logreg", {})])
def test_values_add_up_to_the_score(spark, rows, tmp_path, family, params):
    names = ["a", "b", "c"]
    model = md.family(family, params).fit(rows, names)
    [(_, values)] = sh.explained(model, rows, f"{tmp_path}/trees")
    got = values.join(model.probabilities(rows), md.KEYS).toPandas()
    p = got["p_1"].to_numpy()
    want = p if family in ("random_forest", "extra_trees") else np.log(p / (1 - p))
    assert np.allclose(got[["base", *(f"shap_{n}" for n in names)]].sum(axis=1), want, atol=1e-6)
    if family != "logreg":
        found = sh.leaves(spark, model.fitted[0], f"{tmp_path}/again", 1) if family == "random_forest" else sh.leaves_of(model.fitted[0], 0)
        x = np.array(model.prepared(rows).limit(5).select(sh._array("features")).collect()).reshape(5, 3)
        phi, base = sh.shapley(x, found)
        for row, own in zip(x, phi, strict=True):
            told, least = plain_shapley(found, row)
            assert np.allclose(told, own) and math.isclose(least, base)


@pytest.mark.parametrize("how", ["logreg", "random_forest", "xgboost", "extra_trees", "gru", "stacking"])
def test_a_loaded_model_scores_as_the_saved_one(spark, rows, tmp_path, how):
    names = ["a", "b", "c"]
    model = md.Ensemble(["logreg", "random_forest"], "stacking", {"random_forest": {"n_estimators": 3}}, 2) if how == "stacking" else md.family(how, {} if how == "logreg" else {"epochs": 2, "seq_len": 3} if how == "gru" else {"n_estimators": 3})
    model.fit(rows, names).save(spark, f"{tmp_path}/m")
    a, b = (m.probabilities(rows).orderBy("pos").toPandas() for m in (model, md.load(spark, f"{tmp_path}/m")))
    assert len(a) == (398 if how == "gru" else 400) and np.allclose(a["p_1"], b["p_1"])


def test_balanced_classes_weigh_the_same(rows):
    few = rows.where("label = -1 or pos % 8 = 0")
    plain, even = (md.family("logreg", {"class_weight": w}).fit(few, ["a", "b", "c"]).probabilities(few).agg(F.avg("p_1")).first()[0] for w in ("none", "balanced"))
    share = few.where("label = 1").count() / few.count()
    assert abs(plain - share) < 0.02 < even - share


def test_feature_matrix_guard(spark):
    bars = spark.range(20).selectExpr("'A' as instrument", "id as pos", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts", "id * 1.0D as x")
    own = fo.bars_hash(bars)
    fo.check_feature_matrix(fo.marked(bars, ["x"], own), ["x"], bars)
    for wrong in (bars, fo.marked(bars, ["x"], own, 0), fo.marked(bars, ["x"], "19:0"), fo.marked(bars.union(bars.limit(1)), ["x"], own)):
        with pytest.raises(fo.LeakageError):
            fo.check_feature_matrix(wrong, ["x"], bars)


def test_stages_are_made_again_when_their_settings_change():
    one = ExperimentConfig()
    other = replace(one, backtest=BacktestConfig(cooldown=3))
    a, b = ex.stage_keys(one), ex.stage_keys(other)
    assert a["dataset"] == b["dataset"] and a["walk"] == b["walk"] and a["evaluation"] != b["evaluation"]
    made, kept = [], ex.Stages()
    for config in (one, one, other, replace(other, seed=7)):
        for stage in a:
            kept.get(stage, config, lambda s=stage: made.append(s))
    assert made == ["dataset", "walk", "evaluation", "evaluation", "dataset", "walk", "evaluation"]


def test_runs_with_other_types_and_one_run_alone(spark, tmp_path):
    log = rl.RunLog(spark, str(tmp_path))
    returns = spark.range(10).selectExpr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts", "id / 10 as ret")
    for i, v in enumerate((1, 0.5)):
        log.append({"run_id": f"r{i}", "v": v, **({"more": True} if i else {})}, returns)
    assert sorted((r["run_id"], r["v"], r["more"]) for r in log.runs().collect()) == [("r0", 1.0, None), ("r1", 0.5, True)]
    assert rl.pbo_across(log, ["r0"]).first()["pbo"] is None


def test_a_run_that_broke_off_after_its_returns_is_logged_again(spark, tmp_path, monkeypatch):
    log = rl.RunLog(spark, str(tmp_path))
    returns = spark.range(4).selectExpr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts", "id / 10 as ret")
    log.append({"run_id": "other", "v": 1.0}, returns)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(type(spark), "createDataFrame", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        log.append({"run_id": "a", "v": 1.0}, returns)
    assert log.returns(["a"]).count() == 4 and log.runs().count() == 1
    log.append({"run_id": "a", "v": 1.0}, returns.limit(3))
    assert log.returns(["a"]).count() == 3 and log.returns(["other"]).count() == 4 and log.runs().count() == 2
    with pytest.raises(ValueError):
        log.append({"run_id": "a", "v": 1.0}, returns)


def test_adf_takes_the_lags_of_least_aic(spark):
    rng = np.random.default_rng(3)
    e, x = rng.normal(size=600), [0.0, 0.0]
    for v in e:
        x.append(float(x[-1] + 0.6 * (x[-1] - x[-2]) + v))
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "instrument string, pos long, close double")
    [told] = dg.adf_best(df, "close", 4)
    assert told["lags"] >= 1 and told["p_value"] > 0.05


def test_verdicts():
    assert "0.9" not in mt.dsr_verdict(float("nan"), 3) and "97%" in mt.dsr_verdict(0.97, 3) and "selection" in mt.dsr_verdict(0.4, 3)
    assert "60%" in mt.pbo_verdict(0.6) and "least" in mt.pbo_verdict(None)
    assert "no skill" in mt.random_verdict(0.5, 100) and "no skill" not in mt.random_verdict(0.99, 100)
    assert Rel("t").sql == "SELECT * FROM t"
