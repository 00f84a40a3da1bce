"""The registry of features: backward-looking values of a bar, each from its bar and those before.

A feature is a function of Steps and its parameters that returns an expression, or several by name. Registered
functions are open: `register` adds more.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidegauge.functions.steps import KEYS, Steps


@dataclass(frozen=True)
class Param:
    """A parameter: type (int, float, bool, choice), default, and what it may be."""

    name: str
    type: str
    default: Any
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    help: str = ""

    def checked(self, value: Any) -> Any:
        if self.type == "choice":
            if value not in self.choices:
                raise ValueError(f"{self.name} must be one of {self.choices}, not {value!r}")
            return value
        if self.type == "bool":
            return bool(value)
        value = int(value) if self.type == "int" else float(value)
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ValueError(f"{self.name} = {value} is outside {self.least} to {self.most}")
        return value


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    build: Callable[..., str | dict[str, str]]
    params: tuple[Param, ...] = ()
    description: str = ""
    bounded: bool = False
    extra: dict = field(default_factory=dict)

    def checked(self, params: dict[str, Any]) -> dict[str, Any]:
        if unknown := set(params) - {p.name for p in self.params}:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return {p.name: p.checked(params.get(p.name, p.default)) for p in self.params}


REGISTRY: dict[str, Feature] = {}


def register(name: str, group: str, *params: Param, bounded: bool = False, **extra):
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"a feature {name} exists already")
        REGISTRY[name] = Feature(name, group, build, params, (build.__doc__ or "").strip(), bounded, extra)
        return build

    return add


def window(default: int, least: int = 2, most: int = 500, name: str = "window") -> Param:
    return Param(name, "int", default, least, most)


# shared series


def ret(s: Steps) -> str:
    return s.let(f"ln(close / {s.lag('close')})")


def ema(s: Steps, x: str, n: int) -> str:
    return s.ema(x, 2 / (n + 1), n)


def wilder(s: Steps, x: str, n: int) -> str:
    return s.ema(x, 1 / n, n)


def true_range(s: Steps) -> str:
    before = s.lag("close")
    return s.let(f"greatest(high - low, abs(high - {before}), abs(low - {before}))")


def atr(s: Steps, n: int) -> str:
    return wilder(s, true_range(s), n)


def typical(s: Steps) -> str:
    return s.let("(high + low + close) / 3")


def z(s: Steps, x: str, n: int) -> str:
    x = s.let(x)
    return s.ratio(f"{x} - {s.roll('avg', x, n)}", s.roll("stddev_samp", x, n))


def directional(s: Steps, n: int) -> dict[str, str]:
    up, down = s.let(f"high - {s.lag('high')}"), s.let(f"{s.lag('low')} - low")
    plus = s.let(f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE cast(0 as double) END")
    minus = s.let(f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE cast(0 as double) END")
    range_ = atr(s, n)
    p, m = (s.let(s.ratio(f"100 * {wilder(s, x, n)}", range_)) for x in (plus, minus))
    dx = s.let(s.ratio(f"100 * abs({p} - {m})", f"{p} + {m}"))
    return {"adx": wilder(s, dx, n), "plus_di": p, "minus_di": m}


# trend


@register("sma_ratio", "trend", window(20))
def sma_ratio(s, window):
    """Close over its simple average, less 1."""
    return f"close / {s.roll('avg', 'close', window)} - 1"


@register("ema_ratio", "trend", window(20))
def ema_ratio(s, window):
    """Close over its exponential average, less 1."""
    return f"close / {ema(s, 'close', window)} - 1"


@register("wma_ratio", "trend", window(20))
def wma_ratio(s, window):
    """Close over its average with linear weights, less 1."""
    ranked = s.let("close * pos")
    full = f"count(close) OVER {s.last(window)} = {window}"
    weighted = s.let(f"CASE WHEN {full} THEN sum({ranked}) OVER {s.last(window)} - (pos - {window}) * sum(close) OVER {s.last(window)} END")
    return f"close / ({weighted} / {window * (window + 1) // 2}) - 1"


@register("ma_crossover", "trend", window(20, name="fast"), window(50, name="slow"), Param("kind", "choice", "ema", choices=("sma", "ema")))
def ma_crossover(s, fast, slow, kind):
    """The gap between a fast and a slow average, over the slow one."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    a, b = (ema(s, "close", n) if kind == "ema" else s.roll("avg", "close", n) for n in (fast, slow))
    return f"({a} - {b}) / {b}"


@register("macd", "trend", window(12, name="fast"), window(26, name="slow"), window(9, name="signal"))
def macd(s, fast, slow, signal):
    """Line, signal and histogram, each over the close."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    line = s.let(f"{ema(s, 'close', fast)} - {ema(s, 'close', slow)}")
    smooth = ema(s, line, signal)
    return {"line": f"{line} / close", "signal": f"{smooth} / close", "hist": f"({line} - {smooth}) / close"}


@register("roc", "trend", window(10, 1))
def roc(s, window):
    """Rate of change."""
    return f"close / {s.lag('close', window)} - 1"


@register("momentum", "trend", window(10, 1))
def momentum(s, window):
    """Change of the logarithm of the close."""
    return f"ln(close) - ln({s.lag('close', window)})"


@register("adx", "trend", window(14), bounded=True)
def adx(s, window):
    """Average directional index with both directional indicators."""
    return directional(s, window)


@register("aroon", "trend", window(25), bounded=True)
def aroon(s, window):
    """How long ago the extremes of the last window + 1 bars were, the oldest of equals."""
    frame = s.last(window + 1)
    full = f"count(close) OVER {frame} = {window + 1}"
    pair = (lambda v, k: f"struct({v} AS v, {k} AS k)") if s.spark else (lambda v, k: f"{{'v': {v}, 'k': {k}}}")
    top = s.let(f"CASE WHEN {full} THEN max({pair('high', '-pos')}) OVER {frame} END")
    low = s.let(f"CASE WHEN {full} THEN min({pair('low', 'pos')}) OVER {frame} END")
    up, down = s.let(f"100 * ({window} - (pos + {top}.k)) / {s.num(float(window))}"), s.let(f"100 * ({window} - (pos - {low}.k)) / {s.num(float(window))}")
    return {"up": up, "down": down, "osc": f"{up} - {down}"}


@register("price_ma_zscore", "trend", window(20))
def price_ma_zscore(s, window):
    """Standard score of the close."""
    return z(s, "close", window)


@register("donchian_pos", "trend", window(20), bounded=True)
def donchian_pos(s, window):
    """Place of the close between the lowest low and the highest high."""
    low, high = s.roll("min", "low", window), s.roll("max", "high", window)
    return s.ratio(f"close - {low}", f"{high} - {low}")


# mean reversion


def rsi_of(s: Steps, n: int) -> str:
    change = s.let(f"close - {s.lag('close')}")
    up = wilder(s, s.let(f"CASE WHEN {change} > 0 THEN {change} WHEN {change} IS NOT NULL THEN cast(0 as double) END"), n)
    down = wilder(s, s.let(f"CASE WHEN {change} < 0 THEN -{change} WHEN {change} IS NOT NULL THEN cast(0 as double) END"), n)
    return s.let(f"100 - 100 / (1 + {s.ratio(up, down)})")


@register("rsi", "mean_reversion", window(14), bounded=True)
def rsi(s, window):
    """Relative strength index; nothing where there was no loss."""
    return rsi_of(s, window)


@register("stochastic", "mean_reversion", window(14, name="k"), window(3, 1, name="d"), bounded=True)
def stochastic(s, k, d):
    """Place in the range of k bars, and its average of d."""
    low, high = s.roll("min", "low", k), s.roll("max", "high", k)
    fast = s.let(s.ratio(f"100 * (close - {low})", f"{high} - {low}"))
    return {"k": fast, "d": s.roll("avg", fast, d)}


@register("bollinger", "mean_reversion", window(20), Param("n_std", "float", 2.0, 0.5, 5.0))
def bollinger(s, window, n_std):
    """Place within the bands, and their width over the middle."""
    mid, sd = s.roll("avg", "close", window), s.roll("stddev_samp", "close", window)
    return {"pct_b": s.ratio(f"close - ({mid} - {s.num(n_std)} * {sd})", f"2 * {s.num(n_std)} * {sd}"), "bandwidth": s.ratio(f"2 * {s.num(n_std)} * {sd}", mid)}


@register("williams_r", "mean_reversion", window(14), bounded=True)
def williams_r(s, window):
    """Distance from the highest high in the range, from -100 to 0."""
    low, high = s.roll("min", "low", window), s.roll("max", "high", window)
    return s.ratio(f"-100 * ({high} - close)", f"{high} - {low}")


@register("cci", "mean_reversion", window(20))
def cci(s, window):
    """Typical price from its average, over its mean absolute deviation."""
    tp = typical(s)
    mean, values = s.roll("avg", tp, window), s.listed(tp, s.last(window))
    spread = s.let(f"{s.list_sum(s.mapped(values, 'x', f'abs(x - {mean})'))} / {window}")
    return s.ratio(f"{tp} - {mean}", f"{s.num(0.015)} * {spread}")


@register("ols_residual_z", "mean_reversion", window(20, 5), window(50, 5, name="ma"))
def ols_residual_z(s, window, ma):
    """Residual of a rolling regression of the close on its average, over its own deviation."""
    x = s.roll("avg", "close", ma)
    frame = s.last(window)
    n = f"count({x}) OVER {frame} >= {window}"
    cov = s.let(f"CASE WHEN {n} THEN covar_pop(close, {x}) OVER {frame} END")
    var = s.let(f"CASE WHEN {n} THEN var_pop({x}) OVER {frame} END")
    slope = s.let(s.ratio(cov, var))
    rest = s.let(f"(close - {s.roll('avg', 'close', window)}) - {slope} * ({x} - {s.roll('avg', x, window)})")
    return s.ratio(rest, s.roll("stddev_samp", rest, window))


# volatility


@register("realised_vol", "volatility", window(20))
def realised_vol(s, window):
    """Deviation of log returns."""
    return s.roll("stddev_samp", ret(s), window)


@register("atr", "volatility", window(14))
def atr_feature(s, window):
    """Average true range."""
    return atr(s, window)


@register("natr", "volatility", window(14))
def natr(s, window):
    """Average true range over the close."""
    return f"{atr(s, window)} / close"


@register("parkinson", "volatility", window(20))
def parkinson(s, window):
    """Volatility from highs and lows."""
    return f"sqrt({s.roll('avg', s.let('power(ln(high / low), 2)'), window)} / {s.num(4 * math.log(2))})"


@register("garman_klass", "volatility", window(20))
def garman_klass(s, window):
    """Volatility from open, high, low and close."""
    each = s.let(f"0.5 * power(ln(high / low), 2) - {s.num(2 * math.log(2) - 1)} * power(ln(close / open), 2)")
    return _root(s, s.roll("avg", each, window))


def _root(s: Steps, x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN sqrt(greatest({x}, cast(0 as double))) END"


@register("yang_zhang", "volatility", window(20))
def yang_zhang(s, window):
    """Volatility from overnight moves, sessions and ranges."""
    night, day = s.let(f"ln(open / {s.lag('close')})"), s.let("ln(close / open)")
    rs = s.let("ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)")
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    return _root(s, s.let(f"{s.roll('var_samp', night, window)} + {s.num(k)} * {s.roll('var_samp', day, window)} + {s.num(1 - k)} * {s.roll('avg', rs, window)}"))


@register("vol_ratio", "volatility", window(10, name="short"), window(60, name="long"))
def vol_ratio(s, short, long):
    """Short over long volatility."""
    if short >= long:
        raise ValueError("short must be less than long")
    return s.ratio(s.roll("stddev_samp", ret(s), short), s.roll("stddev_samp", ret(s), long))


@register("vol_of_vol", "volatility", window(20, name="vol_window"), window(60))
def vol_of_vol(s, vol_window, window):
    """Deviation of volatility over its mean."""
    v = s.roll("stddev_samp", ret(s), vol_window)
    return s.ratio(s.roll("stddev_samp", v, window), s.roll("avg", v, window))


# volume


@register("obv_z", "volume", window(20))
def obv_z(s, window):
    """Standard score of on-balance volume."""
    return z(s, s.total(f"coalesce(sign(close - {s.lag('close')}), 0) * volume"), window)


@register("volume_z", "volume", window(20))
def volume_z(s, window):
    """Standard score of volume."""
    return z(s, "volume", window)


@register("vwap_distance", "volume", window(20))
def vwap_distance(s, window):
    """Close over the volume-weighted price, less 1."""
    worth = s.roll("sum", s.let(f"{typical(s)} * volume"), window)
    return f"{s.ratio('close', s.let(s.ratio(worth, s.roll('sum', 'volume', window))))} - 1"


@register("cmf", "volume", window(20), bounded=True)
def cmf(s, window):
    """Money flow by the place of closes in their ranges; a bar without a range leaves it missing."""
    flow = s.let(f"{s.ratio('(close - low) - (high - close)', 'high - low')} * volume")
    return s.ratio(s.roll("sum", flow, window), s.roll("sum", "volume", window))


@register("amihud", "volume", window(20))
def amihud(s, window):
    """Logarithm of mean absolute return per traded money."""
    each = s.let(s.ratio(f"abs(close / {s.lag('close')} - 1)", "close * volume"))
    return f"ln({s.roll('avg', each, window)} * 1e9 + 1e-12)"


# statistical


@register("rolling_skew", "statistical", window(60, 5, 1000))
def rolling_skew(s, window):
    """Skewness of log returns."""
    return s.skewed(ret(s), window, 3)


@register("rolling_kurt", "statistical", window(60, 5, 1000))
def rolling_kurt(s, window):
    """Excess kurtosis of log returns."""
    return s.skewed(ret(s), window, 4)


def hurst_sizes(n: int) -> list[int]:
    """Up to six sizes of chunk, from 10 to half of n, evenly by logarithm."""
    return sorted({int(10 * (n / 20) ** (i / 5) + 1e-9) for i in range(6)}) if n >= 20 else []


@register("hurst", "statistical", window(100, 30, 1000))
def hurst(s, window):
    """Slope of the logarithm of rescaled ranges over that of chunk sizes."""
    r = ret(s)
    values = s.let(f"CASE WHEN count({r}) OVER {s.last(window)} >= {window} THEN {'collect_list' if s.spark else 'list'}({r}) OVER {s.last(window)} END")
    points = []
    for m in hurst_sizes(window):
        means, number = [], []
        for k in range(window // m):
            part = s.let(f"slice({values}, {k * m + 1}, {m})" if s.spark else f"{values}[{k * m + 1}:{(k + 1) * m}]")
            mean = s.let(f"{s.list_sum(part)} / {m}")
            if s.spark:
                walk = f"aggregate({part}, named_struct('c', 0D, 'lo', 1e300D, 'hi', -1e300D, 'q', 0D), (a, x) -> named_struct('c', a.c + x - {mean}, 'lo', least(a.lo, a.c + x - {mean}), 'hi', greatest(a.hi, a.c + x - {mean}), 'q', a.q + (x - {mean}) * (x - {mean})))"
            else:
                walk = f"list_reduce(list_transform({part}, lambda x: {{'c': x - {mean}, 'lo': x - {mean}, 'hi': x - {mean}, 'q': (x - {mean}) * (x - {mean})}}), lambda a, b: {{'c': a.c + b.c, 'lo': least(a.lo, a.c + b.c), 'hi': greatest(a.hi, a.c + b.c), 'q': a.q + b.q}})"
            w = s.let(walk)
            means.append(s.let(f"CASE WHEN {w}.q > 0 THEN ({w}.hi - {w}.lo) / sqrt({w}.q / {m - 1}) END"))
        number = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in means)
        mean_rs = s.let(s.ratio(" + ".join(f"coalesce({x}, 0)" for x in means), f"({number})"))
        points.append((math.log(m), s.let(s.logged(mean_rs))))
    n = s.let(" + ".join(f"CASE WHEN {y} IS NOT NULL THEN 1 ELSE 0 END" for _, y in points))
    sx, sy, sxx, sxy = (s.let(" + ".join(f"CASE WHEN {y} IS NOT NULL THEN {term(x, y)} ELSE 0 END" for x, y in points)) for term in (lambda x, y: s.num(x), lambda x, y: y, lambda x, y: s.num(x * x), lambda x, y: f"{s.num(x)} * {y}"))
    return f"CASE WHEN {n} >= 3 THEN {s.ratio(f'{n} * {sxy} - {sx} * {sy}', f'{n} * {sxx} - {sx} * {sx}')} END"


@register("autocorr", "statistical", window(60, 5, 1000), window(1, 1, 50, name="lag"), bounded=True)
def autocorr(s, window, lag):
    """Correlation of log returns with those lag bars before, inside the window."""
    r = ret(s)
    before = s.lag(r, lag)
    frame = s.last(window - lag)
    full = f"count({r}) OVER {s.last(window)} >= {window}"
    cov, a, b = (s.let(f"CASE WHEN {full} THEN {f} OVER {frame} END") for f in (f"covar_pop({r}, {before})", f"stddev_pop({r})", f"stddev_pop({before})"))
    return s.ratio(cov, f"{a} * {b}")


def frac_weights(d: float, threshold: float, most: int = 100_000) -> list[float]:
    """Coefficients of (1 - B)**d from the newest bar on, as long as they reach the threshold."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


@register("frac_diff", "statistical", Param("d", "float", 0.4, 0.0, 2.0), Param("threshold", "float", 1e-4, 1e-6, 1e-1))
def frac_diff(s, d, threshold):
    """Fractionally differenced logarithm of the close, with a fixed width."""
    w = frac_weights(d, threshold)[::-1]
    log = s.let("ln(close)")
    values = s.listed(log, s.last(len(w)))
    numbers = f"{'array' if s.spark else ''}{'(' if s.spark else '['}{', '.join(s.num(x) for x in w)}{')' if s.spark else ']'}"
    dot = f"aggregate(zip_with({values}, {numbers}, (x, w) -> x * w), 0D, (a, x) -> a + x)" if s.spark else f"list_dot_product({values}, {numbers})"
    return f"CASE WHEN count({log}) OVER {s.last(len(w))} = {len(w)} THEN {dot} END"


# regime


def trailing_rank(s: Steps, x: str, n: int, least: int) -> str:
    """Rank of the value among the last n, ties averaged, over how many there are."""
    x = s.let(x)
    values = s.listed(x, s.last(n))
    below, same = s.size(s.kept(values, "v", f"v < {x}")), s.size(s.kept(values, "v", f"v = {x}"))
    return s.let(f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {s.last(n)} >= {least} THEN ({below} + ({same} + 1) / cast(2 as double)) / {s.size(values)} END")


@register("vol_tercile", "regime", window(20, name="vol_window"), window(250, 20, 2000), bounded=True)
def vol_tercile(s, vol_window, window):
    """Third of the trailing distribution that volatility is in: 0, 1 or 2."""
    rank = trailing_rank(s, s.roll("stddev_samp", ret(s), vol_window), window, window // 2)
    return f"CASE WHEN {rank} IS NOT NULL THEN least(floor(3 * {rank}), 2) END"


@register("trend_range", "regime", window(14), Param("threshold", "float", 25.0, 5.0, 60.0), bounded=True)
def trend_range(s, window, threshold):
    """1 in a trend, by the average directional index, 0 in a range."""
    value = directional(s, window)["adx"]
    return f"CASE WHEN {value} > {s.num(threshold)} THEN cast(1 as double) WHEN {value} IS NOT NULL THEN cast(0 as double) END"


@register("drawdown", "regime")
def drawdown(s):
    """Close over its highest so far, less 1."""
    return f"close / max(close) OVER {s.ALL} - 1"


@register("days_since_ath", "regime", Param("log", "bool", True))
def days_since_ath(s, log):
    """Bars since the highest close so far."""
    top = s.let(f"max(close) OVER {s.ALL}")
    at = s.let(f"CASE WHEN close >= {top} THEN pos END")
    bars = s.let(f"pos - max({at}) OVER {s.ALL}")
    return f"ln(1 + {bars})" if log else f"cast({bars} as double)"


@register("hmm_state", "regime", window(60, 5, 1000, name="refit"), window(250, 50, 5000, name="min_train"), window(50, 5, 500, name="n_iter"), bounded=True, by_series=True)
def hmm_state(s, refit, min_train, n_iter):
    """Probability of the more volatile of two states; see operators.hmm."""
    raise NotImplementedError("a feature of whole series: operators.hmm.hmm_state")


# calendar


@register("day_of_week", "calendar", bounded=True)
def day_of_week(s):
    """Monday is 0."""
    return "weekday(ts)" if s.spark else "isodow(ts) - 1"


@register("month", "calendar", bounded=True)
def month(s):
    """1 to 12."""
    return "month(ts)"


def _month_places(s: Steps) -> tuple[str, str]:
    ym = s.let("year(ts) * 12 + month(ts)")
    first = s.let(f"row_number() OVER (PARTITION BY instrument, {ym} ORDER BY pos)")
    return first, s.let(f"count(*) OVER (PARTITION BY instrument, {ym}) - {first}")


@register("turn_of_month", "calendar", window(3, 1, 10, name="bars"), bounded=True)
def turn_of_month(s, bars):
    """1 in the first and last bars of a month."""
    first, left = _month_places(s)
    return f"CASE WHEN {first} <= {bars} OR {left} < {bars} THEN 1 ELSE 0 END"


@register("days_to_month_end", "calendar")
def days_to_month_end(s):
    """Bars left in the month."""
    return _month_places(s)[1]


# what is done to features


TRANSFORMS = ("raw", "zscore", "rank", "diff", "log")


def transformed(s: Steps, x: str, how: str, n: int) -> str:
    """A feature as it is, as its standard score or rank in a trailing window, its change, or its logarithm."""
    x = s.let(x)
    if how == "zscore":
        least = max(5, n // 2)
        return s.ratio(f"{x} - {s.roll('avg', x, n, least)}", s.roll("stddev_samp", x, n, least))
    if how == "rank":
        return trailing_rank(s, x, n, max(5, n // 2))
    if how == "diff":
        return f"{x} - {s.lag(x)}"
    if how == "log":
        return s.logged(x)
    if how != "raw":
        raise ValueError(f"there is no transform {how}")
    return x


def columns(s: Steps, name: str, params: dict[str, Any] | None = None) -> dict[str, str]:
    """The outputs of a feature: "" or the name of each part to its expression."""
    feature = REGISTRY[name]
    made = feature.build(s, **feature.checked(params or {}))
    return made if isinstance(made, dict) else {"": made}


def feature(bars: DataFrame, name: str, **params) -> DataFrame:
    """instrument, ts, pos and the feature, not shifted, in a column of its name (and part)."""
    if REGISTRY[name].extra.get("by_series"):
        from tidegauge.operators import hmm

        return hmm.hmm_state(bars, **REGISTRY[name].checked(params))
    s = Steps()
    return s.over(bars, {f"{name}__{k}" if k else name: e for k, e in columns(s, name, params).items()}, ["instrument", "ts", "pos"])


def matrix(s: Steps, specs: list, shift: int = 1) -> dict[str, str]:
    """All features of the specs, transformed, and as known `shift` bars later, which their columns say of themselves."""
    if shift < 1:
        raise ValueError("features must be shifted by a bar at least")
    out = {}
    for spec in specs:
        for part, e in columns(s, spec.name, spec.params).items():
            value = s.let(transformed(s, e, spec.transform, spec.transform_window))
            out[spec.column_name() + (f"__{part}" if part else "")] = s.noted(f"lag({value}, {shift}) OVER ({KEYS})", shift=shift, feature=spec.name)
    return out


def feature_matrix(bars: DataFrame, specs: list, shift: int = 1) -> DataFrame:
    s = Steps()
    return s.over(bars, {f"`{k}`".strip("`"): e for k, e in matrix(s, specs, shift).items()}, ["instrument", "ts", "pos"])
