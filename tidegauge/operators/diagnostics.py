"""What went right or wrong: calibration, confusion, regimes, and statistics of series and features.

Relations of predictions have instrument, pos, y_true (-1, 0, 1), p_long and what else is named.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.functions.steps import KEYS, Steps
from tidegauge.operators import features as ft

# predictions


def confusion(oos: Rel) -> Rel:
    """How often each true class was predicted as each."""
    return oos.where("y_true IS NOT NULL AND y_pred IS NOT NULL").agg(["y_true", "y_pred"], n="count(*)")


def log_loss(oos: Rel, keys: list[str], eps: float = 1e-15) -> Rel:
    """Mean loss of p_long against whether the class is 1, accuracy, and how often the commonest class occurs."""
    p = f"greatest(least(p_long, {1 - eps!r}), {eps!r})"
    hit = "CASE WHEN y_true = y_pred THEN cast(1 as double) ELSE cast(0 as double) END"
    up = "avg(CASE WHEN y_true = 1 THEN cast(1 as double) ELSE cast(0 as double) END)"
    return oos.where("y_true IS NOT NULL AND p_long IS NOT NULL").agg(keys, n="count(*)", log_loss=f"-avg(CASE WHEN y_true = 1 THEN ln({p}) ELSE ln(1 - {p}) END)", accuracy=f"avg({hit})", majority=f"greatest({up}, 1 - {up})")


def probability_by_class(oos: Rel) -> Rel:
    """p_long of every prediction with the class that came true."""
    return oos.where("y_true IS NOT NULL AND p_long IS NOT NULL").select("instrument", "pos", "p_long", true_class="y_true")


def calibration(oos: Rel, bins: int = 10) -> Rel:
    """Mean prediction and share of hits in bins of equal size by quantiles of p_long; a value on an edge goes below it."""
    rows = oos.where("y_true IS NOT NULL AND p_long IS NOT NULL")
    edges = rows.agg([], **{f"e{i}": rows.percentile("p_long", i / bins) for i in range(1, bins)})
    cross = rows.df.crossJoin(F.broadcast(edges.df)) if rows.spark else f"(SELECT * FROM {rows.source} CROSS JOIN {edges.source})"
    bin_ = " + ".join(f"CASE WHEN p_long > e{i} THEN 1 ELSE 0 END" for i in range(1, bins))
    return Rel(cross).steps(lambda s: {"bin": bin_}).agg(["bin"], mean_predicted="avg(p_long)", fraction_positive="avg(CASE WHEN y_true = 1 THEN cast(1 as double) ELSE cast(0 as double) END)", n="count(*)")


def regimes(result: Rel, vol_window: int = 20, bars_a_year: float = 252.0) -> Rel:
    """Return and Sharpe ratio of strategy and benchmark by thirds of volatility, by trend, and by depth of drawdown."""

    def build(s: Steps) -> dict[str, str]:
        vol = s.roll("stddev_samp", ft.ret(s), vol_window)
        n = s.let(f"count({vol}) OVER (PARTITION BY instrument)")
        turn = s.let(f"CASE WHEN {vol} IS NOT NULL THEN row_number() OVER (PARTITION BY instrument ORDER BY {vol} IS NULL, {vol}, pos) END")
        third = lambda k: f"1 + ({n} - 1) * {k} / {s.num(3.0)}"
        up = s.let(f"coalesce({s.roll('avg', 'close', 50)} > {s.roll('avg', 'close', 200)}, false)")
        depth = s.let(f"close / max(close) OVER {s.ALL} - 1")
        return {
            "vol": f"CASE WHEN {turn} <= {third(1)} THEN 'low_vol' WHEN {turn} <= {third(2)} THEN 'mid_vol' WHEN {turn} IS NOT NULL THEN 'high_vol' END",
            "trend": f"CASE WHEN {up} THEN 'ma50>ma200' ELSE 'ma50<ma200' END",
            "drawdown": f"CASE WHEN {depth} > -1 AND {depth} <= -0.2 THEN 'dd>20%' WHEN {depth} > -0.2 AND {depth} <= -0.1 THEN 'dd 10-20%' WHEN {depth} > -0.1 THEN 'dd<10%' END",
        }

    rows, out = result.steps(build), None
    ratio = lambda x: f"CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / nullif(stddev_samp({x}), 0) * {bars_a_year**0.5!r} END"
    for kind in ("vol", "trend", "drawdown"):
        one = rows.where(f"{kind} IS NOT NULL").select("instrument", "net", "benchmark", regime=kind).agg(["instrument", "regime"], n_bars="count(*)", strategy_ann_return=f"avg(net) * {bars_a_year}", strategy_sharpe=ratio("net"), bench_ann_return=f"avg(benchmark) * {bars_a_year}", bench_sharpe=ratio("benchmark"))
        one = one.steps(lambda s, k=kind: {"regime_type": f"'{k}'"})
        out = one if out is None else out.union(one)
    return out


def best_regime(table: Rel) -> Rel:
    return table.agg(["instrument", "regime_type"], best="max_by(regime, strategy_sharpe)")


# series


def returns(bars: Rel) -> Rel:
    return bars.steps(lambda s: {"r": ft.ret(s)})


def autocorrelation(bars: Rel, lags: int = 10) -> Rel:
    """Autocorrelation of log returns at each lag, and the bound within which it is noise."""
    rows = returns(bars).where("r IS NOT NULL").steps(lambda s: {"d": f"r - {s.let('avg(r) OVER (PARTITION BY instrument)')}"})
    rows = rows.steps(lambda s: {f"p{k}": f"d * lag(d, {k}) OVER ({KEYS})" for k in range(1, lags + 1)})
    sums = rows.agg(["instrument"], n="count(*)", q="sum(d * d)", **{f"s{k}": f"sum(p{k})" for k in range(1, lags + 1)})
    return sums.melted(["instrument"], [{"lag": str(k), "acf": f"s{k} / nullif(q, 0)", "bound": "1.96 / sqrt(n)"} for k in range(1, lags + 1)])


def partial(acf: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1, 2, ... by Levinson's recursion."""
    out, before = [], []
    for k, r in enumerate(acf):
        down = 1 - sum(a * b for a, b in zip(before, acf, strict=False))
        phi = (r - sum(a * acf[k - 1 - i] for i, a in enumerate(before))) / down if down else math.nan
        before = [a - phi * b for a, b in zip(before, before[::-1], strict=True)] + [phi]
        out.append(phi)
    return out


def jarque_bera(bars: Rel) -> Rel:
    """Skewness, excess kurtosis, the statistic and its p value, of log returns."""
    rows = returns(bars)
    skew = rows.one("skewness(r)", "skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1.0))")
    kurt = rows.one("kurtosis(r)", "kurtosis_pop(r)")
    out = rows.agg(["instrument"], n="count(r)", skew=skew, kurt=kurt)
    return out.steps(lambda s: {"jb": (jb := s.let("n / cast(6 as double) * (skew * skew + kurt * kurt / 4)")), "p_value": f"exp(-{jb} / 2)"})


def histogram(bars: Rel, bins: int = 40, low: float = -0.06, high: float = 0.06) -> Rel:
    """How many log returns lie in each bin; the first and last hold what lies beyond."""
    width = (high - low) / bins
    return returns(bars).where("r IS NOT NULL").steps(lambda s: {"bin": f"cast(least(greatest(floor((r - {s.num(low)}) / {s.num(width)}), 0), {bins - 1}) as bigint)"}).agg(["instrument", "bin"], n="count(*)")


def normal_curve(bars: Rel, bins: int = 40, low: float = -0.06, high: float = 0.06) -> Rel:
    """For each bin of histogram() how many log returns a normal distribution of their mean and deviation would put there, by its density at the middle."""
    width = (high - low) / bins
    facts = returns(bars).agg(["instrument"], n="count(r)", m="avg(r)", sd="stddev_samp(r)")
    pdf = lambda x: f"n * {width!r} * exp(-power(({x!r} - m) / nullif(sd, 0), 2) / 2) / (nullif(sd, 0) * sqrt(2 * pi()))"
    return facts.melted(["instrument"], [{"bin": str(i), "expected": pdf(low + (i + 0.5) * width)} for i in range(bins)])


def label_drift(labels: Rel, window: int = 60, least: int = 20) -> Rel:
    """Trailing share of labels that are 1."""
    return labels.steps(lambda s: {"share": s.roll("avg", s.let("CASE WHEN label = 1 THEN cast(1 as double) WHEN label IS NOT NULL THEN cast(0 as double) END"), window, least)})


#: Polynomials in the statistic for the p value of a unit root test with a constant, from MacKinnon (1994): below and above the turning point.
ADF_TURN, ADF_SMALL, ADF_LARGE = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: The least and greatest statistic that they hold for.
ADF_RANGE = (-18.83, 2.74)


def adf_p(statistic: float) -> float:
    if statistic < ADF_RANGE[0]:
        return 0.0
    if statistic > ADF_RANGE[1]:
        return 1.0
    terms = ADF_SMALL if statistic <= ADF_TURN else ADF_LARGE
    return 0.5 * math.erfc(-sum(c * statistic**i for i, c in enumerate(terms)) / math.sqrt(2))


def adf(rows: DataFrame, x: str = "close", lags: int = 1, where: str | None = None) -> list[dict]:
    """Per instrument the unit root statistic with a constant and `lags` lagged changes, and its p value; at least 30 rows.

    The regression is from sums of products, one aggregation over all rows."""

    def build(s: Steps) -> dict[str, str]:
        change = s.let(f"{x} - {s.lag(x)}")
        return {"dy": change, "y1": s.lag(x)} | {f"d{k}": s.lag(change, k) for k in range(1, lags + 1)}

    names = ["one", "y1", *(f"d{k}" for k in range(1, lags + 1))]
    r = Rel(rows).steps(build).df.withColumn("one", F.lit(1.0)).dropna(subset=["dy", *names])
    r = r.where(where) if where else r
    every = [*names, "dy"]
    sums = r.groupBy("instrument").agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(every) for b in every[i:])).collect()
    out = []
    for row in sums:
        m = np.array([[row[f"{a}|{b}"] if f"{a}|{b}" in row else row[f"{b}|{a}"] for b in every] for a in every], float)
        k = len(names)
        if row["n"] < 30 or np.linalg.matrix_rank(m[:k, :k]) < k:
            out.append({"instrument": row["instrument"], "statistic": math.nan, "p_value": math.nan, "aic": math.nan})
            continue
        beta = np.linalg.solve(m[:k, :k], m[:k, k])
        s2 = (m[k, k] - beta @ m[:k, k]) / (row["n"] - k)
        t = float(beta[1] / math.sqrt(s2 * np.linalg.inv(m[:k, :k])[1, 1]))
        n, rss = row["n"], s2 * (row["n"] - k)
        aic = n * (math.log(2 * math.pi * rss / n) + 1) + 2 * k
        out.append({"instrument": row["instrument"], "statistic": t, "p_value": adf_p(t), "aic": aic})
    return out


def adf_best(rows: DataFrame, x: str = "close", most: int = 4) -> list[dict]:
    """adf() with the number of lagged changes, up to `most`, that has the least AIC over the bars that all of them can use."""

    def build(s: Steps) -> dict[str, str]:
        return {"usable": f"row_number() OVER ({KEYS}) > {most + 1}"}

    kept = Rel(rows).steps(build).df
    tried: dict[str, list[dict]] = {}
    for lags in range(most + 1):
        for r in adf(kept, x, lags, "usable"):
            tried.setdefault(r["instrument"], []).append(r | {"lags": lags})
    return [min(t, key=lambda r: (math.isnan(r["aic"]), r["aic"], r["lags"])) for _, t in sorted(tried.items())]


def kpss(rows: DataFrame, x: str = "close", lags: int | None = None) -> DataFrame:
    """Per instrument the statistic of stationarity around a level, with a Bartlett window of 12 (n / 100)**0.25 lags."""
    n = rows.groupBy("instrument").count().agg(F.max("count")).first()[0] or 0
    lags = int(np.ceil(12 * (n / 100) ** 0.25)) if lags is None else lags
    e = Rel(rows).steps(lambda s: {"e": f"{x} - {s.let(f'avg({x}) OVER (PARTITION BY instrument)')}"})
    e = e.steps(lambda s: {"walk": s.total("e")} | {f"c{k}": f"e * lag(e, {k}) OVER ({KEYS})" for k in range(1, lags + 1)})
    long = " + ".join(["sum(e * e)", *(f"2 * {1 - k / (lags + 1)!r} * coalesce(sum(c{k}), 0)" for k in range(1, lags + 1))])
    return e.agg(["instrument"], n="count(*)", eta="sum(walk * walk)", long_run=long).select("instrument", statistic="eta / n / nullif(long_run, 0)").df


def min_stationary_d(bars: DataFrame, level: float = 0.05, threshold: float = 1e-4) -> dict[str, float]:
    """Per instrument the least order of differencing, in tenths from 0 to 1, at which a unit root is rejected."""
    out: dict[str, float] = {}
    for d in (i / 10 for i in range(11)):
        made = ft.feature(bars, "frac_diff", d=d, threshold=threshold).where("frac_diff is not null")
        for row in adf(made, "frac_diff"):
            if row["p_value"] < level:
                out.setdefault(row["instrument"], d)
    return out


# features


def correlations(rows: Rel, names: list[str]) -> Rel:
    """Correlation of each pair of features over rows that have both; one aggregation over all rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = {f"r{k}": f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)" for k, (a, b) in enumerate(pairs)}
    return rows.agg(["instrument"], **sums).melted(["instrument"], [{"correlation": f"r{k}", "feature_a": f"'{a}'", "feature_b": f"'{b}'"} for k, (a, b) in enumerate(pairs)])


def alike(rows: Rel, names: list[str], limit: float = 0.9) -> Rel:
    """Pairs of features whose correlation is over the limit, either way."""
    return correlations(rows, names).where(f"abs(correlation) > {limit}")


def noise(importance: DataFrame) -> DataFrame:
    """Features that a model does better without."""
    return importance.where("importance < 0").select("feature", "importance")


def variance_inflation(rows: DataFrame, names: list[str]) -> dict[str, float]:
    """How much each feature's variance is explained by the others: the diagonal of the inverse correlation matrix."""
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(rows.dropna(subset=names).select(*names))
    m = Correlation.corr(vectors, "v").first()[0].toArray()
    return dict(zip(names, np.diag(np.linalg.pinv(m)).tolist(), strict=True))


def mutual_information(rows: DataFrame, names: list[str], label: str = "label", bins: int = 16) -> DataFrame:
    """Information that each feature, in bins of equal size, gives about the label, in nats. Counts only are shuffled."""
    cuts = rows.agg(*(F.percentile(n, [i / bins for i in range(1, bins)]).alias(n) for n in names)).first()
    out = None
    for n in names:
        bin_ = sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n] or []), F.lit(0))
        c = rows.where(F.col(n).isNotNull() & F.col(label).isNotNull()).groupBy(bin_.alias("b"), F.col(label).alias("y")).agg(F.count("*").cast("double").alias("n"))
        total, by_b, by_y = c.agg(F.sum("n").alias("t")), c.groupBy("b").agg(F.sum("n").alias("nb")), c.groupBy("y").agg(F.sum("n").alias("ny"))
        one = c.join(by_b, "b").join(by_y, "y").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("information")).withColumn("feature", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def linear_shap(rows: DataFrame, names: list[str], coefficients: list[float]) -> DataFrame:
    """What each feature adds to a linear model's score of a row: its coefficient by its distance from the mean."""
    means = rows.agg(*(F.avg(n).alias(f"__m_{n}") for n in names))
    return rows.crossJoin(F.broadcast(means)).select("*", *((F.lit(float(c)) * (F.col(n) - F.col(f"__m_{n}"))).alias(f"shap_{n}") for n, c in zip(names, coefficients, strict=True))).drop(*(f"__m_{n}" for n in names))
