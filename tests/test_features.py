"""Features against pandas, and the property that no feature looks ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.functions.steps import Steps
from tidegauge.operators import features as ft
from tidegauge.operators import hmm
from tidegauge.plans.config import FeatureSpec
from tidegauge.sources import bars as br


@pytest.fixture(scope="module")
def bars(spark):
    return br.synthetic(spark, 420, seed=11).cache()


@pytest.fixture(scope="module")
def pdf(bars):
    return bars.orderBy("pos").toPandas()


def values(bars, name, **params):
    out = ft.feature(bars, name, **params).orderBy("pos").toPandas()
    return out.drop(columns=["instrument", "ts", "pos"])


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    ok = ~np.isnan(a)
    assert np.allclose(a[ok], b[ok], rtol=tol, atol=tol)


def test_averages(bars, pdf):
    c = pdf["close"]
    same(values(bars, "sma_ratio", window=20)["sma_ratio"], c / c.rolling(20).mean() - 1)
    same(values(bars, "ema_ratio", window=20)["ema_ratio"], c / c.ewm(span=20, adjust=False, min_periods=20).mean() - 1)
    same(values(bars, "ema_ratio", window=2)["ema_ratio"], c / c.ewm(span=2, adjust=False, min_periods=2).mean() - 1)
    w = np.arange(1, 11)
    same(values(bars, "wma_ratio", window=10)["wma_ratio"], c / c.rolling(10).apply(lambda x: (x * w).sum() / w.sum(), raw=True) - 1, 1e-7)


def test_macd_and_rsi(bars, pdf):
    c = pdf["close"]
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
    line = ema(c, 12) - ema(c, 26)
    same(values(bars, "macd")["macd__hist"], (line - ema(line, 9)) / c)
    d = c.diff()
    wild = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    same(values(bars, "rsi")["rsi"], 100 - 100 / (1 + wild(d.clip(lower=0)) / wild(-d.clip(upper=0))))


def test_average_with_gaps(spark):
    x = [1.0, None, None, 2.0, 3.0, None, 5.0] * 40
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "instrument string, pos long, x double")
    s = Steps()
    out = s.over(rows, {"y": s.ema("x", 0.5, 2)}).orderBy("pos").toPandas()["y"]
    same(out, pd.Series(x, dtype=float).ewm(alpha=0.5, adjust=False, min_periods=2).mean())


def test_statistics(bars, pdf):
    r = np.log(pdf["close"]).diff()
    same(values(bars, "rolling_skew", window=60)["rolling_skew"], r.rolling(60).skew(), 1e-7)
    same(values(bars, "rolling_kurt", window=60)["rolling_kurt"], r.rolling(60).kurt(), 1e-6)
    vol = r.rolling(20).std()
    rank = vol.rolling(100, min_periods=50).rank(pct=True)
    same(values(bars, "vol_tercile", vol_window=20, window=100)["vol_tercile"], np.minimum(np.floor(3 * rank), 2))
    tp = (pdf["high"] + pdf["low"] + pdf["close"]) / 3
    mad = tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    same(values(bars, "cci")["cci"], (tp - tp.rolling(20).mean()) / (0.015 * mad), 1e-7)


def test_hurst(bars, pdf):
    def rs(x):
        xs, ys = [], []
        for m in ft.hurst_sizes(len(x)):
            got = []
            for k in range(len(x) // m):
                part = x[k * m : (k + 1) * m]
                walk = np.cumsum(part - part.mean())
                if part.std(ddof=1) > 0:
                    got.append((walk.max() - walk.min()) / part.std(ddof=1))
            xs.append(np.log(m))
            ys.append(np.log(np.mean(got)))
        return np.polyfit(xs, ys, 1)[0]

    r = np.log(pdf["close"]).diff()
    same(values(bars, "hurst", window=60)["hurst"], r.rolling(60).apply(rs, raw=True), 1e-6)


def test_frac_diff_of_order_one_is_a_difference(bars, pdf):
    same(values(bars, "frac_diff", d=1.0)["frac_diff"], np.log(pdf["close"]).diff())
    assert [len(ft.frac_weights(d, 1e-4)) for d in (0.0, 0.4, 0.5, 1.0)] == [1, 282, 200, 2]


def test_aroon_takes_the_oldest_of_equals(spark):
    rows = spark.createDataFrame([("A", i, 1.0, h, h, h) for i, h in enumerate([1.0, 3.0, 2.0, 3.0, 1.0])], "instrument string, pos long, open double, high double, low double, close double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    out = ft.feature(rows, "aroon", window=4).where("pos = 4").first()
    assert out["aroon__up"] == 25.0 and out["aroon__down"] == 0.0


SMALL = {"vol_tercile": {"window": 100}, "hurst": {"window": 60}, "rolling_skew": {"window": 40}, "rolling_kurt": {"window": 40}, "frac_diff": {"d": 0.9}, "vol_of_vol": {"window": 30}, "hmm_state": {"refit": 60, "min_train": 100, "n_iter": 5}}


def test_no_feature_looks_ahead(bars):
    """All values are multiplied from bar 300 on; nothing before may change."""
    spiked = bars.select("instrument", "ts", "pos", *((F.when(F.col("pos") >= 300, F.col(c) * 8).otherwise(F.col(c))).alias(c) for c in br.COLUMNS))
    names = [n for n, f in ft.REGISTRY.items() if not f.extra.get("by_series")]
    changed = False
    for part in range(0, len(names), 11):
        s, out = Steps(), {}
        for n in names[part : part + 11]:
            out |= {f"{n}__{k}": e for k, e in ft.columns(s, n, SMALL.get(n)).items()}
        a, b = (s.over(x, out, ["pos"]).orderBy("pos").toPandas().astype(float) for x in (bars, spiked))
        pd.testing.assert_frame_equal(a[:300], b[:300])
        changed |= not a[300:].equals(b[300:])
    assert changed
    a, b = (ft.feature(x, "hmm_state", **SMALL["hmm_state"]).orderBy("pos").toPandas()["hmm_state"] for x in (bars, spiked))
    pd.testing.assert_series_equal(a[:300], b[:300])


def test_features_are_known_a_bar_later(bars):
    specs = [FeatureSpec("roc", {"window": 1}), FeatureSpec("roc", {"window": 3}, "zscore", 20)]
    made = ft.feature_matrix(bars, specs).orderBy("pos").toPandas()
    plain = values(bars, "roc", window=1)["roc"]
    same(made["roc_window1"], plain.shift(1))
    assert "roc_window3__zscore20" in made
    with pytest.raises(ValueError):
        ft.feature_matrix(bars, specs, shift=0)


def test_transforms(bars, pdf):
    x = pdf["close"] / pdf["close"].shift(1) - 1
    for how, want in (("rank", x.rolling(30, min_periods=15).rank(pct=True)), ("zscore", (x - x.rolling(30, min_periods=15).mean()) / x.rolling(30, min_periods=15).std()), ("diff", x.diff()), ("log", np.log(x.where(x > 0)))):
        s = Steps()
        e = ft.transformed(s, ft.columns(s, "roc", {"window": 1})[""], how, 30)
        same(s.over(bars, {"y": e}, ["pos"]).orderBy("pos").toPandas()["y"], want, 1e-8)


def test_parameters_are_checked(bars):
    with pytest.raises(ValueError):
        ft.feature(bars, "sma_ratio", window=1)
    with pytest.raises(ValueError):
        ft.feature(bars, "sma_ratio", length=5)
    with pytest.raises(ValueError):
        ft.feature(bars, "ma_crossover", fast=50, slow=20)
    with pytest.raises(ValueError):
        ft.register("sma_ratio", "trend")(lambda s: "close")
    assert len(ft.REGISTRY) == 44


def test_instruments_do_not_mix(spark, bars):
    other = bars.withColumn("instrument", F.lit("B")).withColumns({c: F.col(c) * 3 for c in br.OHLC})
    both = ft.feature(bars.unionByName(other), "rsi").where("instrument = 'SYN'").orderBy("pos").toPandas()["rsi"]
    same(both, values(bars, "rsi")["rsi"])


def plain_states(close, refit, min_train, n_iter):
    """The hidden Markov feature of one series bar by bar."""
    r = np.diff(np.log(close), prepend=np.nan)
    out, model = np.full(len(r), np.nan), None
    for t in range(min_train, len(r)):
        if (t - min_train) % refit == 0:
            train = r[1:t][~np.isnan(r[1:t])]
            model = (hmm.fit(train, n_iter) if len(train) >= min_train // 2 else None) or model
        window = r[max(1, t - hmm.LOOK_BACK) : t + 1]
        if model is not None and not np.isnan(window).any():
            out[t] = hmm._passes(window, *model)[0][-1, int(np.argmax(model[3]))]
    return out


def closes(seed, runs):
    rng = np.random.default_rng(seed)
    wild = np.repeat(np.arange(runs) % 2, 150).astype(bool)
    return wild, 100 * np.exp(np.cumsum(rng.normal(0, np.where(wild, 0.03, 0.005))))


def hidden(spark, series, **how):
    rows = [(k, i, None if np.isnan(c) else float(c)) for k, x in series.items() for i, c in enumerate(x)]
    bars = spark.createDataFrame(rows, "instrument string, pos long, close double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    out = hmm.hmm_state(bars, **how).orderBy("instrument", "pos").toPandas()
    assert out.columns.tolist() == ["instrument", "ts", "pos", "hmm_state"] and len(out) == len(rows)
    return {k: g["hmm_state"].to_numpy(float) for k, g in out.groupby("instrument")}


@pytest.mark.parametrize("block", [4096, 200])
def test_hidden_states_are_those_of_a_series_bar_by_bar(spark, block):
    """Fits within one block, and fits that many blocks make together: holes, a flat series and a short one among them."""
    wild, close = closes(3, 4)
    holes = close.copy()
    holes[[0, 120, 333]] = np.nan
    series = {"whole": close, "holes": holes, "flat": np.full(450, 7.0), "short": close[:50]}
    got = hidden(spark, series, refit=90, min_train=150, n_iter=6, block=block)
    for k, x in series.items():
        np.testing.assert_allclose(got[k], plain_states(x, 90, 150, 6), rtol=1e-6, atol=1e-8, equal_nan=True)
    p = got["whole"]
    assert np.nanmean(p[wild & ~np.isnan(p)]) > 0.8 > 0.3 > np.nanmean(p[~wild & ~np.isnan(p)])
    assert np.isnan(got["flat"]).all() and np.isnan(got["short"]).all()


def test_hidden_states_of_no_bars(spark):
    bars = spark.createDataFrame([], "instrument string, ts timestamp_ntz, pos long, close double")
    assert hmm.hmm_state(bars).count() == 0


def test_a_relation_without_steps_is_its_table():
    assert Rel("x").sql == "SELECT * FROM x"
