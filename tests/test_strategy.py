"""Labels, folds, backtests and metrics by hand, and an experiment from end to end."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.functions.steps import Steps
from tidegauge.operators import backtest as bt
from tidegauge.operators import diagnostics as dg
from tidegauge.operators import features as ft
from tidegauge.operators import folds as fo
from tidegauge.operators import labels as lb
from tidegauge.operators import metrics as mt
from tidegauge.operators import models as md
from tidegauge.plans import config as cf
from tidegauge.plans import experiment as ex
from tidegauge.sources import bars as br
from tidegauge.sources import runs as rl


def bars_of(spark, close, open_=None, spread=1.0):
    rows = [("A", i, float(o), float(c + spread), float(c - spread), float(c), 1.0) for i, (c, o) in enumerate(zip(close, open_ or close, strict=True))]
    df = spark.createDataFrame(rows, "instrument string, pos long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.expr("cast(date_add(date'2024-01-01', cast(pos as int)) as timestamp_ntz)"))


def column(rel, name):
    return [r[name] for r in rel.df.orderBy("pos").collect()]


def test_fixed_horizon(spark):
    r = Rel(bars_of(spark, [100, 101, 101, 100.9, 102, 102.01]))
    assert column(lb.fixed_horizon(r, 1), "label") == [1, -1, -1, 1, 1, None]
    assert column(lb.fixed_horizon(r, 1, 0.005, True), "label") == [1, 0, 0, 1, 0, None]


def test_triple_barrier(spark):
    close = [100.0] * 12
    close[5], close[9] = 103, 94
    out = lb.triple_barrier(Rel(bars_of(spark, close)), 4, 1.0, 1.0, 2).df.orderBy("pos").collect()
    assert out[0]["label"] is None and out[8]["label"] is None
    assert (out[3]["barrier"], out[3]["label"], out[3]["t1_pos"]) == ("pt", 1, 5)
    assert out[3]["ret"] == pytest.approx(0.02)
    assert (out[7]["barrier"], out[7]["label"]) == ("sl", -1)
    short = lb.triple_barrier(Rel(bars_of(spark, close).withColumn("side", F.lit(-1))), 4, 1.0, 1.0, 2, "side").df.where("pos = 3").first()
    assert (short["barrier"], short["label"]) == ("sl", -1) and short["ret"] == pytest.approx(-0.02)


def test_trend_scanning(spark):
    up = [100 * math.exp(0.01 * i + 0.001 * math.sin(i)) for i in range(60)]
    out = lb.trend_scanning(Rel(bars_of(spark, up)), 5, 15).df.orderBy("pos").collect()
    assert all(r["label"] == 1 for r in out[:46]) and all(r["label"] is None for r in out[46:])
    assert all(5 <= r["trend_window"] <= 15 and r["t1_pos"] == r["pos"] + r["trend_window"] - 1 for r in out[:46])
    assert lb.trend_scanning(Rel(bars_of(spark, up[::-1])), 5, 15).df.where("label = 1").count() == 0


def test_weights(spark):
    rows = spark.createDataFrame([("A", i, 100.0 + i, t) for i, t in enumerate([2, 3, None, None, None, None])], "instrument string, pos long, close double, t1_pos long")
    assert column(lb.concurrency(Rel(rows), 3), "concurrency") == [1, 2, 2, 1, 0, 0]
    w = column(lb.weights(Rel(rows), 3), "weight")
    assert w[:2] == pytest.approx([1.0, 1.0]) and w[2:] == [None] * 4
    assert column(lb.weights(Rel(rows), 3, "none"), "weight") == [1.0] * 6


def test_folds():
    made = fo.folds(1000, "rolling", 200, 50, 50, 5)
    assert len(made) == 16 and made[0].test_start == 205 and made[-1].test_end == 1000
    fo.check_folds(made, "rolling", 200, 50, 5)
    assert all(f.train_start == 0 for f in fo.folds(1000, "expanding", 200, 50, 50, 5))
    with pytest.raises(ValueError):
        fo.folds(100, train=200)
    with pytest.raises(fo.LeakageError):
        fo.check_folds([replace(made[0], test_start=200)], "rolling", 200, 50, 5)


def test_purge(spark):
    rows = Rel(bars_of(spark, [100 + math.sin(i) for i in range(300)]))
    made = fo.folds(300, "rolling", 100, 50, 50, 0)
    m = fo.members(lb.fixed_horizon(rows, 5), Rel(fo.fold_table(spark, made))).df
    assert m.where("role = 'train' and t1_pos >= test_start").count() == 0
    assert fo.summary(Rel(m)).df.where("fold_id = 0").first()["n_train"] == 95


def test_leaks_are_found(spark):
    rows = lb.fixed_horizon(Rel(bars_of(spark, [100 + math.sin(i) for i in range(200)])), 5).steps(lambda s: {"cheat": "ret * 2", "fair": "volume"})
    with pytest.raises(fo.LeakageError):
        fo.check_labels_in_features(rows, ["cheat", "fair"])
    fo.check_labels_in_features(rows, ["fair"])
    with pytest.raises(fo.LeakageError):
        fo.check_alignment(rows.df, rows.df.where("pos > 3"))


def test_probe_finds_what_looks_ahead(spark):
    bars = br.synthetic(spark, 120, seed=6)
    causal = lambda b: ft.feature(b, "rsi").select("pos", "rsi")
    ahead = lambda b: lb.fixed_horizon(Rel(b), 3).df.select("pos", "ret")
    assert fo.looks_ahead(bars, causal, 80) == 0 and fo.looks_ahead(bars, ahead, 80) == 3


def test_pairs_and_noise(spark):
    rows = spark.range(50).selectExpr("'A' instrument", "cast(id as double) a", "cast(id * 2 as double) b", "cast(id % 3 as double) c")
    assert [(r["feature_a"], r["feature_b"]) for r in dg.alike(Rel(rows), ["a", "b", "c"]).df.collect()] == [("a", "b")]
    assert dg.noise(spark.createDataFrame([("x", -0.1), ("y", 0.2)], "feature string, importance double")).count() == 1


def test_profit_with_costs(spark):
    r = Rel(bars_of(spark, [100.5, 101.5, 102.5, 103.5], [100, 101, 102, 103])).steps(lambda s: {"held": "CASE WHEN pos < 2 THEN 1 ELSE 0 END", "size": s.num(1.0), "reason": "cast(null as varchar(9))"})
    out = bt.pnl(r, commission_bps=10, spread_bps=0, slippage_bps=0)
    assert column(out, "position") == [0, 1, 1, 0]
    assert column(out, "net") == pytest.approx([0, 102 / 101 - 1 - 0.001, 103 / 102 - 1, -0.001])
    t = bt.trades(out).df.collect()
    assert len(t) == 1 and t[0]["bars_held"] == 2 and t[0]["side"] == "long"
    assert t[0]["pnl"] == pytest.approx((102 / 101 - 0.001) * (103 / 102) - 1)


def test_product_of_any_signs(spark):
    x = [1.1, -0.5, 2.0, -1.0, 0.0, 3.0]
    s = Steps()
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "instrument string, pos long, x double")
    out = s.over(rows, {"y": bt.product(s, "x", s.ALL)}, ["pos"]).orderBy("pos").toPandas()["y"]
    assert np.allclose(out, np.cumprod(x))


def walked(spark, wants, cooldown, most):
    rows = spark.createDataFrame([(k, i, int(w)) for k, want in wants.items() for i, w in enumerate(want)], "instrument string, pos long, want int")
    out = bt.walked_targets(rows, cooldown, most).orderBy("instrument", "pos").collect()
    return {k: ([r["held"] for r in out if r["instrument"] == k], [r["reason"] for r in out if r["instrument"] == k]) for k in wants}


def stepwise(want, cooldown, most):
    """Position and reason from one bar to the next: (held, bars held, bars to wait)."""
    state, out = (0, 0, 0), []
    for w in map(int, want):
        held, age, wait = state
        over = bool(held and most and age + 1 == most)
        if held and w == held and not over:
            state, why = (held, age + 1, 0), None
        elif held:
            why = "max_holding" if over else "flip" if w else "signal"
            state = (w, 0, 0) if why == "flip" and not cooldown else (0, 0, cooldown)
        else:
            state, why = ((0, 0, wait - 1) if wait else (w, 0, 0)), None
        out.append((state[0], why))
    return [h for h, _ in out], [r for _, r in out]


def test_state_machine(spark):
    held, reason = walked(spark, {"A": [1] * 8}, 1, 2)["A"]
    assert held == [1, 1, 0, 0, 1, 1, 0, 0] and reason[2] == "max_holding"
    held, reason = walked(spark, {"A": [1, -1, -1, 0]}, 0, 9)["A"]
    assert held == [1, -1, -1, 0] and reason == [None, "flip", None, "signal"]


def test_state_machine_by_runs_is_the_stepwise_one(spark):
    rng = np.random.default_rng(1)
    wants = {f"{i}": np.repeat(rng.integers(-1, 2, 60), rng.integers(1, 3 + 3 * i, 60)) for i in range(4)} | {"short": [1], "flat": [0, 0, 0]}
    for cooldown, most in ((1, 0), (3, 0), (0, 1), (0, 4), (2, 1), (3, 5), (9, 2)):
        for k, told in walked(spark, wants, cooldown, most).items():
            assert told == stepwise(wants[k], cooldown, most), (k, cooldown, most)


def test_state_machine_without_limits_is_the_column_form(spark):
    want = np.random.default_rng(1).integers(-1, 2, 300)
    assert walked(spark, {"A": want}, 0, 0)["A"] == stepwise(want, 0, 0)


def test_sizes(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
    r = Rel(bars_of(spark, close.tolist(), spread=0.5)).steps(lambda s: {"want": "1", "p_long": s.num(0.75), "p_short": s.num(0.25)})
    vol = np.array(column(bt.sized(r, "vol_target"), "size"))
    assert (vol[:10] == 1).all() and vol.max() <= 2 and vol[50:].std() > 0
    kelly = np.array(column(bt.sized(r, "kelly"), "size"))
    assert (kelly[:59] == 0).all() and 0 <= kelly.min() and kelly.max() <= 0.5
    assert column(bt.sized(r, "confidence"), "size")[0] == pytest.approx(1.0)


def test_drawdown_and_sharpe(spark):
    eq = [1.0, 1.1, 0.9, 1.0, 1.05, 1.2]
    rows = spark.createDataFrame([("A", i, e, e) for i, e in enumerate(eq)], "instrument string, pos long, equity double, net double")
    out = mt.max_drawdown(Rel(rows)).df.first()
    assert out["max_drawdown"] == pytest.approx(0.9 / 1.1 - 1) and out["drawdown_duration_bars"] == 3
    assert rows.agg(F.expr(mt.sharpe_of("net", 252.0))).first()[0] == pytest.approx(np.mean(eq) / np.std(eq, ddof=1) * math.sqrt(252))


def test_luck():
    few = mt.deflated_sharpe(0.08, 1000, 0.0, 3.0, [0.01, 0.05, 0.08])
    many = mt.deflated_sharpe(0.08, 1000, 0.0, 3.0, [0.01, 0.05, 0.08], trials=300)
    assert few["psr"] == pytest.approx(many["psr"]) and few["dsr"] > many["dsr"] and few["psr"] > 0.99
    assert mt.expected_max_sharpe(1, 1.0) == 0.0


def test_noise_is_overfitted_half_of_the_time(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(v)) for s, column_ in enumerate(rng.normal(0, 0.01, (10, 400))) for t, v in enumerate(column_)]
    returns = Rel(spark.createDataFrame(rows, "series int, pos long, r double"))
    out = mt.pbo_share(mt.pbo(returns, 8, spark=spark)).df.first()
    assert out["n_combinations"] == 70 and 0.15 <= out["pbo"] <= 0.85


def test_random_benchmark(spark):
    rng = np.random.default_rng(5)
    p, r = np.repeat(rng.integers(-1, 2, 40), 10).astype(float), rng.normal(0, 0.01, 400)
    rows = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, np.where(p != 0, np.abs(r) * p, r), strict=True))], "instrument string, pos long, position double, benchmark double")
    out = bt.random_benchmark(rows, 1e-4, n=100).first()
    assert out["percentile"] > 0.95 and out["n_random"] == 100


def test_random_benchmark_equals_its_orders_bar_by_bar(spark):
    rng = np.random.default_rng(6)
    p, r = np.repeat(rng.choice([-1.0, 0.0, 0.5], 30), rng.integers(1, 7, 30)), rng.normal(0.001, 0.01, 200)
    r = r[: p.size]
    edge = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    value, length = p[edge], np.diff(np.append(edge, p.size))

    def sharpe(q):
        net = q * r - np.abs(np.diff(q, prepend=0.0)) * 1e-3
        return net.mean() / net.std(ddof=1) * 252**0.5

    drawn = []
    for k in range(50):
        o = sorted(range(edge.size), key=lambda i: hashlib.md5(f"9|A|{k}|{i + 1}".encode()).hexdigest())
        drawn.append(sharpe(np.repeat(value[o], length[o])))
    rows = [("A", i + 7, float(a), float(b)) for i, (a, b) in enumerate(zip(p, r, strict=True))] + [("B", i, 1.0, 0.01 * (i % 3)) for i in range(9)] + [("C", i, 0.0, 0.01) for i in range(5)] + [("D", 0, 1.0, None)]
    out = {x["instrument"]: x for x in bt.random_benchmark(spark.createDataFrame(rows, "instrument string, pos long, position double, benchmark double"), 1e-3, n=50, seed=9).collect()}
    assert out["A"]["real_sharpe"] == pytest.approx(sharpe(p)) and out["A"]["random_mean"] == pytest.approx(np.mean(drawn)) and out["A"]["percentile"] == pytest.approx(np.mean(np.array(drawn) < sharpe(p)))
    assert out["B"]["real_sharpe"] is not None and out["B"]["percentile"] is None and [out[k]["n_random"] for k in "ABCD"] == [50, 0, 0, 0]
    assert out["C"]["real_sharpe"] is None and out["D"]["real_sharpe"] is None


def test_statistics_of_series(spark):
    assert dg.partial([0.5, 0.25, 0.125])[0] == 0.5 and abs(dg.partial([0.5, 0.25, 0.125])[1]) < 1e-12
    walk = np.cumsum(np.random.default_rng(1).normal(0, 1, 600)) + 200
    flat = np.random.default_rng(2).normal(0, 1, 600) + 200
    assert dg.adf(bars_of(spark, walk.tolist()))[0]["p_value"] > 0.05 > dg.adf(bars_of(spark, flat.tolist()))[0]["p_value"]
    assert dg.adf_p(-2.86) == pytest.approx(0.05, abs=0.003)
    names = ["open", "volume"]
    assert dg.variance_inflation(bars_of(spark, walk.tolist()).withColumn("volume", F.rand(1)), names)["volume"] == pytest.approx(1, abs=0.05)
    shap = dg.linear_shap(bars_of(spark, [1.0, 2.0, 3.0]), ["close"], [2.0]).orderBy("pos").collect()
    assert [r["shap_close"] for r in shap] == [-2.0, 0.0, 2.0]


# configuration


def test_config_round_trip_and_hash():
    c = cf.ExperimentConfig(features=cf.FeatureConfig([cf.FeatureSpec("rsi", {"window": 14}, "rank", 30)]))
    again = cf.ExperimentConfig.from_json(c.to_json())
    assert again == c and again.config_hash() == c.config_hash() and len(c.config_hash()) == 16
    assert replace(c, data=replace(c.data, force_refresh=True)).config_hash() == c.config_hash()
    assert replace(c, seed=1).config_hash() != c.config_hash()
    assert c.features.features[0].column_name() == "rsi_window14__rank30"
    with pytest.raises(ValueError):
        cf.ExperimentConfig.from_dict({"sed": 1})


@pytest.mark.parametrize("part", [cf.CostConfig(0, 0, 0), cf.FeatureConfig(), cf.DataConfig(ticker=" "), cf.LabelConfig(horizon=0), cf.SizingConfig(kelly_max=2), cf.BacktestConfig(long_threshold=1), cf.BacktestConfig(direction="up"), cf.FeatureSpec("rsi", {}, "rank", 3)])
def test_settings_are_checked(part):
    with pytest.raises(ValueError):
        part.validate()


def test_embargo_covers_the_labels():
    with pytest.raises(ValueError):
        cf.WalkForwardConfig(embargo=3).validate(5)
    cf.WalkForwardConfig(embargo=3, i_know_what_i_am_doing=True).validate(5)


# bars


def test_cleaning_and_reports(spark):
    day = lambda d: F.expr(f"timestamp_ntz'2024-01-{d:02d}'")
    rows = spark.createDataFrame([(1, 1, 10.0), (2, 1, 11.0), (3, 3, None), (4, 2, 12.0)], "seq int, d int, close double")
    raw = rows.select("seq", F.lit("A").alias("instrument"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(d - 1)").alias("ts"), *(F.coalesce("close", F.lit(1.0)).alias(c) for c in ("open", "high", "low")), "close", F.lit(1.0).alias("volume"))
    out = br.cleaned(raw, "seq").orderBy("pos").collect()
    assert [r["close"] for r in out] == [11.0, 12.0] and day(1) is not None
    assert br.integrity(raw, "seq").first()["duplicates"] == 1 and br.integrity(raw, "seq").first()["out_of_order"] == 1
    assert br.report(br.synthetic(spark, 100))[0].warnings
    assert br.cache_name("^A/B=C") == "IDX_A_B_C"


def test_cache(spark, tmp_path):
    calls = []

    def fetch(*_):
        calls.append(1)
        return br.synthetic(spark, 30).drop("pos", "instrument").withColumnRenamed("ts", "Date")

    for _ in range(2):
        assert br.load(spark, str(tmp_path), "^X", "1d", "2015", "2016", fetch).count() == 30
    assert len(calls) == 1
    br.load(spark, str(tmp_path), "^X", "1d", "2015", "2016", fetch, refresh=True)
    assert len(calls) == 2


# from end to end

CONFIG = cf.ExperimentConfig(
    features=cf.FeatureConfig([cf.FeatureSpec("rsi", {"window": 14}), cf.FeatureSpec("natr", {"window": 14}), cf.FeatureSpec("momentum", {"window": 10})]),
    walkforward=cf.WalkForwardConfig(train_window=300, test_window=150, step=150, embargo=5),
)


def test_experiment(spark, tmp_path):
    bars, log = br.synthetic(spark, 700, seed=4), rl.RunLog(spark, str(tmp_path))
    ds, w, ev = ex.run(bars, CONFIG, log)
    pos = [r["pos"] for r in w.oos.orderBy("pos").collect()]
    assert pos == list(range(pos[0], pos[-1] + 1)) and pos[0] - (w.folds[0].train_end - 1) == 6
    assert set(mt.PERFORMANCE) <= set(ev.metrics["SYN"]) and 0 <= ev.luck["SYN"]["psr"] <= 1
    other = replace(CONFIG, model=cf.ModelConfig(family="random_forest", params={"n_estimators": 5}))
    ex.run(bars, other, log)
    runs = log.runs()
    assert runs.count() == 2 and sorted(r["n_trials_at_run"] for r in runs.collect()) == [1, 2]
    board = rl.leaderboard(runs).collect()
    assert board[0]["m_sharpe"] >= board[1]["m_sharpe"] and board[0]["n_trials_now"] == 2
    facts = rl.trial_facts(Rel(runs)).df.first()
    want = mt.probabilistic_sharpe(board[0]["sharpe_per_bar"], mt.expected_max_sharpe(2, facts["variance"]), board[0]["m_n_bars"], board[0]["ret_skew"], board[0]["ret_kurtosis"])
    assert board[0]["dsr_now"] == pytest.approx(want, abs=1e-6)
    assert rl.parallel_coordinates(rl.leaderboard(runs)).count() == 2
    ids = [r["run_id"] for r in board]
    assert len(log.returns_matrix(ids).columns) == 3
    with pytest.raises(ValueError):
        log.append({"run_id": ids[0]}, ev.result.select("ts", F.col("net").alias("ret")))


def test_models_keep_their_contract(spark):
    ds = ex.prepare(br.synthetic(spark, 420, seed=9), replace(CONFIG, label=cf.LabelConfig(three_class=True, deadband=0.005)))
    train, test = ds.rows.where("pos < 300"), ds.rows.where("pos >= 310")
    for name in ("logreg", "xgboost", "lightgbm"):
        m = md.family(name, {"n_estimators": 2, "max_depth": 2} if name != "logreg" else {}).fit(train, ds.names)
        out = m.probabilities(test).collect()
        assert len(out) == test.count() and all(sum(r[p] for p in md.PROBABILITIES) == pytest.approx(1) for r in out)
    with pytest.raises(ValueError):
        md.family("logreg").fit(train.limit(5), ds.names)
    with pytest.raises(ValueError):
        md.family("magic")


def test_votes(spark):
    a = spark.createDataFrame([("A", 0, 0.2, 0.0, 0.8), ("A", 1, 0.6, 0.0, 0.4)], "instrument string, pos long, p_m1 double, p_0 double, p_1 double")
    b = spark.createDataFrame([("A", 0, 0.6, 0.0, 0.4)], a.schema)
    soft = {r["pos"]: r["p_1"] for r in md.vote([a, b]).collect()}
    assert soft[0] == pytest.approx(0.6) and soft[1] == pytest.approx(0.4)
    hard = {r["pos"]: r["p_1"] for r in md.vote([a, b], "hard").collect()}
    assert hard[0] == 0.5 and hard[1] == 0.0


def test_meta_signals(spark):
    rows = spark.createDataFrame([("A", 0, 1.0), ("A", 1, -1.0), ("A", 2, 0.0)], "instrument string, pos long, side double")
    p = spark.createDataFrame([("A", i, 0.3, 0.0, 0.7) for i in range(3)], "instrument string, pos long, p_m1 double, p_0 double, p_1 double")
    assert [r["p_long"] for r in md.meta_signals(p, rows).orderBy("pos").collect()] == pytest.approx([0.7, 0.3, 0.5])
