"""Performance, and how far it may be luck: Sharpe ratios deflated by trials, and the probability of overfitting."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np

from tidegauge.functions.relation import Rel
from tidegauge.functions.steps import Steps

EULER = 0.5772156649015329


def sharpe_of(x: str, bars_a_year: float) -> str:
    """An aggregate: mean over deviation, annualised; nothing for a constant."""
    return f"CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / nullif(stddev_samp({x}), 0) * {bars_a_year**0.5!r} END"


def grown(x: str) -> str:
    """An aggregate: the product of 1 + x, less 1, whatever the signs of its factors."""
    factor = f"CASE WHEN 1 + {x} <> 0 THEN ln(abs(CASE WHEN 1 + {x} <> 0 THEN 1 + {x} END)) END"
    sign = f"CASE WHEN sum(CASE WHEN 1 + {x} = 0 THEN 1 ELSE 0 END) > 0 THEN 0 WHEN sum(CASE WHEN 1 + {x} < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END"
    return f"({sign}) * exp(coalesce(sum({factor}), 0)) - 1"


def drawdowns(result: Rel, equity: str = "equity") -> Rel:
    """Of each bar its distance from the highest equity so far, and the run of bars under water it is in."""

    def build(s: Steps) -> dict[str, str]:
        top = s.let(f"max({equity}) OVER {s.ALL}")
        depth = s.let(f"{equity} / {top} - 1")
        dry = s.let(f"CASE WHEN {depth} < 0 THEN 0 ELSE 1 END")
        return {"depth": depth, "under": s.total(dry)}

    return result.steps(build)


def max_drawdown(result: Rel, equity: str = "equity") -> Rel:
    """max_drawdown, and the longest run of bars under water."""
    rows = drawdowns(result, equity)
    runs = rows.agg(["instrument", "under"], n="sum(CASE WHEN depth < 0 THEN 1 ELSE 0 END)").agg(["instrument"], drawdown_duration_bars="max(n)")
    return rows.agg(["instrument"], max_drawdown="min(depth)").join(runs, ["instrument"])


def worst_month(result: Rel) -> Rel:
    month = result.steps(lambda s: {"month_key": "year(ts) * 12 + month(ts)"}).agg(["instrument", "month_key"], r=grown("net"))
    return month.agg(["instrument"], worst_month="min(r)")


def alpha_beta(result: Rel, bars_a_year: float = 252.0) -> Rel:
    beta = "covar_samp(net, benchmark) / nullif(var_samp(benchmark), 0)"
    return result.agg(["instrument"], n="count(*)", beta=f"CASE WHEN count(*) >= 10 THEN {beta} END", alpha_annual=f"CASE WHEN count(*) >= 10 THEN (avg(net) - {beta} * avg(benchmark)) * {bars_a_year} END").select("instrument", "alpha_annual", "beta")


def performance(result: Rel, trades: Rel, bars_a_year: float = 252.0) -> Rel:
    """The 24 figures of a backtest, a row an instrument: one pass over bars, one over trades, and the drawdowns."""
    q = result.percentile
    first, last = (lambda x: f"min_by({x}, pos)"), (lambda x: f"max_by({x}, pos)")
    bars = result.agg(
        ["instrument"], n_bars="count(*)", first_equity=first("equity"), last_equity=last("equity"), ann_vol=f"stddev_samp(net) * {bars_a_year**0.5!r}", sharpe=sharpe_of("net", bars_a_year),
        sortino=f"avg(net) / nullif(sqrt(avg(power(least(net, 0), 2))), 0) * {bars_a_year**0.5!r}", turnover_annual=f"sum(turnover) / count(*) * {bars_a_year}", avg_exposure="avg(CASE WHEN position <> 0 THEN cast(1 as double) ELSE cast(0 as double) END)",
        tail_ratio=f"CASE WHEN count(*) > 20 THEN abs({q('net', 0.95)} / nullif({q('net', 0.05)}, 0)) END", bench_last=last("benchmark_equity"), bench_sharpe=sharpe_of("benchmark", bars_a_year),
    )
    t = trades.agg(["instrument"], n_trades="count(*)", hit_rate="avg(CASE WHEN pnl > 0 THEN cast(1 as double) ELSE cast(0 as double) END)", avg_win="avg(CASE WHEN pnl > 0 THEN pnl END)", avg_loss="avg(CASE WHEN pnl <= 0 THEN pnl END)", gain="coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0)", loss="coalesce(-sum(CASE WHEN pnl <= 0 THEN pnl END), 0)", expectancy="avg(pnl)")
    b = max_drawdown(result, "benchmark_equity").select("instrument", bench_max_drawdown="max_drawdown")
    all_ = bars.join(t, ["instrument"], "left").join(max_drawdown(result), ["instrument"]).join(b, ["instrument"]).join(worst_month(result), ["instrument"]).join(alpha_beta(result, bars_a_year), ["instrument"])
    cagr = f"CASE WHEN last_equity <= 0 OR first_equity <= 0 THEN cast(-1 as double) ELSE power(last_equity / first_equity, {bars_a_year} / n_bars) - 1 END"
    out = all_.select(
        "instrument", "ann_vol", "sharpe", "sortino", "max_drawdown", "drawdown_duration_bars", "hit_rate", "avg_win", "avg_loss", "expectancy", "turnover_annual", "avg_exposure", "tail_ratio", "worst_month", "alpha_annual", "beta", "bench_sharpe", "bench_max_drawdown", "n_bars",
        cagr=cagr, n_trades="coalesce(n_trades, 0)", total_return="last_equity - 1", bench_total_return="bench_last - 1", profit_factor="CASE WHEN loss > 0 THEN gain / nullif(loss, 0) WHEN gain > 0 THEN cast('Infinity' as double) END",
    )
    return out.steps(lambda s: {"calmar": "CASE WHEN max_drawdown < 0 THEN cagr / abs(nullif(max_drawdown, 0)) END"})


PERFORMANCE = ["cagr", "ann_vol", "sharpe", "sortino", "calmar", "max_drawdown", "drawdown_duration_bars", "hit_rate", "avg_win", "avg_loss", "profit_factor", "expectancy", "turnover_annual", "avg_exposure", "n_trades", "tail_ratio", "worst_month", "alpha_annual", "beta", "total_return", "bench_total_return", "bench_sharpe", "bench_max_drawdown", "n_bars"]


def rolling_sharpe(result: Rel, window: int = 63, bars_a_year: float = 252.0) -> Rel:
    return result.steps(lambda s: {"rolling_sharpe": f"{s.ratio(s.roll('avg', 'net', window), s.roll('stddev_samp', 'net', window))} * {s.num(bars_a_year**0.5)}"})


# luck


def moments(result: Rel, x: str = "net", key: str = "instrument") -> Rel:
    """n, Sharpe ratio per bar, population skewness and non-excess kurtosis of each series."""
    skew = result.one(f"skewness({x})", f"skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0))")
    kurt = result.one(f"kurtosis({x}) + 3", f"kurtosis_pop({x}) + 3")
    return result.agg([key], n=f"count({x})", sr=f"avg({x}) / nullif(stddev_samp({x}), 0)", skew=skew, kurt=kurt)


def psr_z(rows: Rel, against: str = "cast(0 as double)") -> Rel:
    """z: how many deviations the Sharpe ratio per bar lies above another, by its own moments."""
    return rows.steps(lambda s: {"z": f"(sr - {against}) * sqrt(n - 1) / sqrt(greatest({s.num(1e-12)}, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))"})


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def probabilistic_sharpe(sr: float, against: float, n: int, skew: float, kurt: float) -> float:
    """The probability that the true Sharpe ratio per bar is above another."""
    if n < 2 or not math.isfinite(sr):
        return math.nan
    return normal_cdf((sr - against) * math.sqrt(n - 1) / math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """What the best of so many worthless trials would show."""
    if trials <= 1 or not variance > 0:
        return 0.0
    inverse = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, trial_sharpes: list[float], trials: int | None = None) -> dict[str, float]:
    """Probabilities against 0 and against the best of the trials, and whether the latter reaches 0.95."""
    known = [x for x in trial_sharpes if x is not None and math.isfinite(x)]
    variance = float(np.var(known, ddof=1)) if len(known) > 1 else 0.0
    bar = expected_max_sharpe(trials if trials is not None else len(known), variance)
    dsr = probabilistic_sharpe(sr, bar, n, skew, kurt)
    return {"psr": probabilistic_sharpe(sr, 0.0, n, skew, kurt), "dsr": dsr, "sr0": bar, "variance": variance, "significant": bool(dsr >= 0.95)}


def pbo(returns: Rel, n_blocks: int = 10, most: int = 2000, seed: int = 0, spark=None) -> Rel:
    """A row for each way to choose half of the blocks: the best series in the chosen half, its rank in the rest, and the logit of that.

    returns has series (0, 1, ...), pos and r, for bars that all series have. Blocks are reduced to counts, sums and
    squares first, so that combinations meet blocks and not bars.
    """
    if n_blocks % 2:
        raise ValueError("the number of blocks must be even")
    chosen = list(combinations(range(n_blocks), n_blocks // 2))
    if len(chosen) > most:
        chosen = [chosen[i] for i in np.random.default_rng(seed).choice(len(chosen), most, replace=False)]
    pairs = [(i, b, int(b in c)) for i, c in enumerate(chosen) for b in range(n_blocks)]
    sides = Rel(spark.createDataFrame(pairs, "combo long, block long, train int")) if returns.spark else Rel(f"(SELECT * FROM (VALUES {', '.join(map(str, pairs))}) AS t(combo, block, train))")
    div = lambda a, b: f"({a} div {b})" if returns.spark else f"({a} // {b})"

    def blocks(s: Steps) -> dict[str, str]:
        total = s.let("max(seat) OVER (PARTITION BY series) + 1")
        q, m = s.let(div(total, n_blocks)), s.let(f"{total} % {n_blocks}")
        return {"block": f"CASE WHEN seat < {m} * ({q} + 1) THEN {div('seat', f'({q} + 1)')} ELSE {m} + {div(f'(seat - {m} * ({q} + 1))', f'nullif({q}, 0)')} END"}

    def place(s: Steps) -> dict[str, str]:
        return {"seat": "row_number() OVER (PARTITION BY series ORDER BY pos) - 1"}

    parts = returns.steps(place).steps(blocks).agg(["series", "block"], n="count(*)", mean="avg(r)", m2="var_pop(r) * count(*)")
    sums = parts.join(sides, ["block"]).agg(["combo", "train", "series"], total="sum(n)", s1="sum(n * mean)", s2="sum(m2 + n * mean * mean)")
    ratio = sums.select("combo", "train", "series", sr="CASE WHEN s2 - s1 * s1 / total > 1e-18 THEN s1 / total / sqrt((s2 - s1 * s1 / total) / (total - 1)) ELSE cast('-Infinity' as double) END")
    rank = lambda s: {"best": "row_number() OVER (PARTITION BY combo, train ORDER BY sr DESC, series)", "rank": f"{s.let('rank() OVER (PARTITION BY combo, train ORDER BY sr)')} + ({s.let('count(*) OVER (PARTITION BY combo, train, sr)')} - 1) / cast(2 as double)", "many": "count(*) OVER (PARTITION BY combo, train)"}
    ranked = ratio.steps(rank)
    best = ranked.where("train = 1 AND best = 1").select("combo", "series", sr_in="sr")
    out = best.join(ranked.where("train = 0").select("combo", "series", "rank", "many", sr_out="sr"), ["combo", "series"])
    return out.steps(lambda s: {"logit": f"ln({s.let('rank / (many + 1)')} / (1 - {s.let('rank / (many + 1)')}))"})


def pbo_share(combos: Rel) -> Rel:
    return combos.agg([], pbo="avg(CASE WHEN logit < 0 THEN cast(1 as double) ELSE cast(0 as double) END)", n_combinations="count(*)")


# in words


def dsr_verdict(dsr: float | None, trials: int) -> str:
    if dsr is None or not math.isfinite(dsr):
        return "There are too few bars to deflate the Sharpe ratio."
    if dsr >= 0.95:
        return f"Given {trials} trials, the true Sharpe ratio is above what the best of as many worthless ones would show with a probability of {dsr:.0%}."
    return f"With a probability of only {dsr:.0%} this is more than the best of {trials} worthless trials would show: it may well be selection."


def pbo_verdict(pbo: float | None) -> str:
    if pbo is None or not math.isfinite(pbo):
        return "Two logged runs over common bars are the least that the probability of overfitting can be told from."
    side = "likelier than not" if pbo > 0.5 else "less likely than not"
    return f"The best in sample falls behind the median out of sample with a probability of {pbo:.0%}: it is {side} to disappoint."


def random_verdict(percentile: float | None, n: int) -> str:
    if percentile is None or not math.isfinite(percentile):
        return "There was nothing to shuffle."
    return f"It beats {percentile:.0%} of {n} shuffles of its own positions" + (", which shows no skill." if percentile < 0.95 else ".")
