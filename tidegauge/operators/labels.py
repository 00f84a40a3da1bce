"""What a model is to predict: labels of bars from later bars, and weights for labels that overlap.

Labels add to the bars: label, ret, t1 and t1_pos (when the label is known), and what the scheme has besides.
All frames are bounded by the horizon, so that nothing is joined and a bar is read once.
"""

from __future__ import annotations

from tidegauge.functions.relation import Rel
from tidegauge.functions.steps import KEYS, Steps
from tidegauge.operators.features import atr


def fixed_horizon(bars: Rel, horizon: int = 5, deadband: float = 0.0, three_class: bool = False) -> Rel:
    """The sign of the return over the horizon; with three classes 0 within the deadband."""

    def build(s: Steps) -> dict[str, str]:
        r = s.let(f"lead(close, {horizon}) OVER ({KEYS}) / close - 1")
        two = f"CASE WHEN {r} > 0 THEN 1 WHEN {r} <= 0 THEN -1 END"
        three = f"CASE WHEN {r} > {s.num(deadband)} THEN 1 WHEN {r} < {s.num(-deadband)} THEN -1 WHEN {r} IS NOT NULL THEN 0 END"
        return {"label": three if three_class else two, "ret": r, "t1": f"lead(ts, {horizon}) OVER ({KEYS})", "t1_pos": f"lead(pos, {horizon}) OVER ({KEYS})"}

    return bars.steps(build)


def triple_barrier(bars: Rel, horizon: int = 5, pt: float = 2.0, sl: float = 1.0, atr_window: int = 14, side: str | None = None, pessimistic: bool = False) -> Rel:
    """Which of two barriers, multiples of the average true range away, is touched first, at the barrier's price.

    side names a column of -1, 0 or 1. A bar that touches both counts as the lower barrier, which is a loss for
    longs; with `pessimistic` it is one for shorts too. No touch takes the sign of the return at the horizon.
    """

    def build(s: Steps) -> dict[str, str]:
        way = s.let(f"coalesce({side}, 0)") if side else "1"
        range_ = atr(s, atr_window)
        ahead = s.frame("1 FOLLOWING", f"{horizon} FOLLOWING")
        up = s.let(f"close + (CASE WHEN {way} > 0 THEN {s.num(pt)} ELSE {s.num(sl)} END) * {range_}")
        down = s.let(f"close - (CASE WHEN {way} > 0 THEN {s.num(sl)} ELSE {s.num(pt)} END) * {range_}")
        place = lambda xs, test: s.let(f"nullif(coalesce({'array_position' if s.spark else 'list_position'}({s.mapped(xs, 'x', f'x {test}')}, true), 0), 0)")
        hit_up, hit_down = place(s.listed("high", ahead), f">= {up}"), place(s.listed("low", ahead), f"<= {down}")
        live = s.let(f"{range_} > 0 AND {way} <> 0 AND lead(pos, {horizon}) OVER ({KEYS}) IS NOT NULL")
        first = s.let(f"least({hit_up}, {hit_down})")
        lower = f"({hit_down} IS NOT NULL AND ({hit_up} IS NULL OR {hit_down} <= {hit_up}))"
        if pessimistic:
            lower = f"(CASE WHEN {hit_up} = {hit_down} THEN {way} > 0 ELSE {lower} END)"
        at_low = s.let(lower)
        after = s.let(f"coalesce({first}, {horizon})")
        price = s.let(f"CASE WHEN {first} IS NULL THEN lead(close, {horizon}) OVER ({KEYS}) WHEN {at_low} THEN {down} ELSE {up} END")
        r = s.let(f"CASE WHEN {live} THEN {way} * ({price} / close - 1) END")
        kind = s.let(f"CASE WHEN NOT coalesce({live}, false) THEN NULL WHEN {first} IS NULL THEN 'vertical' WHEN {at_low} = ({way} > 0) THEN 'sl' ELSE 'pt' END")
        times = s.let(f"{'collect_list' if s.spark else 'list'}(ts) OVER {ahead}")
        when = f"CASE WHEN {live} THEN {f'get({times}, cast({after} as int) - 1)' if s.spark else f'{times}[{after}]'} END"
        return {"label": f"CASE WHEN {kind} = 'pt' THEN 1 WHEN {kind} = 'sl' THEN -1 WHEN {r} > 0 THEN 1 WHEN {r} IS NOT NULL THEN -1 END", "barrier": kind, "ret": r, "t1": when, "t1_pos": f"CASE WHEN {live} THEN pos + {after} END"}

    return bars.steps(build)


def trend_scanning(bars: Rel, least: int = 5, most: int = 20, step: int = 1) -> Rel:
    """The sign of the trend ahead whose slope has the largest t-statistic over windows of `least` to `most` bars; the shortest of equals."""
    if least < 3 or most <= least or step < 1:
        raise ValueError("windows run from 3 at least to more, by a positive step")

    def build(s: Steps) -> dict[str, str]:
        y = s.let("ln(close)")
        x = s.let("cast(pos as double)")
        live = s.let(f"lead(pos, {most - 1}) OVER ({KEYS}) IS NOT NULL")
        best, size = s.num(0.0), "0"
        for n in range(least, most + 1, step):
            frame = s.frame("CURRENT ROW", f"{n - 1} FOLLOWING")
            sxx = n * (n * n - 1) / 12
            sxy = s.let(f"covar_pop({y}, {x}) OVER {frame} * {n}")
            syy = s.let(f"var_pop({y}) OVER {frame} * {n}")
            b = s.let(f"{sxy} / {s.num(sxx)}")
            error = s.let(f"({syy} - {b} * {sxy}) / {s.num((n - 2) * sxx)}")
            t = s.let(f"CASE WHEN NOT {live} THEN NULL WHEN {error} > 0 THEN {b} / sqrt({error}) ELSE sign({b}) * {s.num(1e6)} END")
            more = s.let(f"abs({t}) > abs({best})")
            best, size = s.let(f"CASE WHEN {more} THEN {t} ELSE {best} END"), s.let(f"CASE WHEN {more} THEN {n} ELSE {size} END")
        ahead = s.frame("CURRENT ROW", f"{most - 1} FOLLOWING")
        closes, times = s.listed("close", ahead), s.let(f"{'collect_list' if s.spark else 'list'}(ts) OVER {ahead}")
        ok = s.let(f"{live} AND {size} > 0")
        item = lambda xs: f"get({xs}, {size} - 1)" if s.spark else f"{xs}[{size}]"
        return {"label": f"CASE WHEN {ok} THEN CASE WHEN {best} > 0 THEN 1 ELSE -1 END END", "t_value": f"CASE WHEN {ok} THEN {best} END", "trend_window": f"CASE WHEN {ok} THEN {size} END", "ret": f"CASE WHEN {ok} THEN {item(closes)} / close - 1 END", "t1": f"CASE WHEN {ok} THEN {item(times)} END", "t1_pos": f"CASE WHEN {ok} THEN pos + {size} - 1 END"}

    return bars.steps(build)


def _live(s: Steps, horizon: int) -> str:
    """How many labels of at most that horizon are open at a bar."""
    ends = s.listed("t1_pos", s.frame(f"{horizon} PRECEDING", "CURRENT ROW"))
    return s.let(f"cast({s.size(s.kept(ends, 'e', 'e >= pos'))} as double)")


def concurrency(labels: Rel, horizon: int) -> Rel:
    return labels.steps(lambda s: {"concurrency": _live(s, horizon)})


def weights(labels: Rel, horizon: int, scheme: str = "uniqueness") -> Rel:
    """weight: none (1), uniqueness (mean share of the bars a label spans), return_attribution, or both; mean 1 per instrument."""
    if scheme not in ("none", "uniqueness", "return_attribution", "both"):
        raise ValueError(f"there is no weighting {scheme}")
    if scheme == "none":
        return labels.steps(lambda s: {"weight": s.num(1.0)})

    def build(s: Steps) -> dict[str, str]:
        live = _live(s, horizon)
        span = s.let("t1_pos - pos")
        cut = lambda xs, n: f"slice({xs}, 1, cast({n} as int))" if s.spark else f"{xs}[1:{n}]"
        share = s.listed(s.let(f"coalesce(1 / nullif({live}, 0), 0)"), s.frame("CURRENT ROW", f"{horizon} FOLLOWING"))
        full = s.listed(s.let(f"CASE WHEN {live} > 0 THEN 1 ELSE 0 END"), s.frame("CURRENT ROW", f"{horizon} FOLLOWING"))
        total = lambda xs: f"aggregate({xs}, cast(0 as double), (a, v) -> a + v)" if s.spark else f"list_sum({xs})"
        unique = s.let(f"CASE WHEN t1_pos IS NOT NULL THEN {total(cut(share, f'({span} + 1)'))} / nullif({total(cut(full, f'({span} + 1)'))}, 0) END")
        r = s.let(f"ln(close / {s.lag('close')})")
        part = s.listed(s.let(f"coalesce({r} / nullif({live}, 0), 0)"), s.frame("1 FOLLOWING", f"{horizon} FOLLOWING"))
        gained = s.let(f"CASE WHEN {span} > 0 THEN abs({total(cut(part, span))}) END")
        every = "OVER (PARTITION BY instrument)"
        normal = lambda w: s.let(f"CASE WHEN avg({w}) {every} > 0 THEN {w} / (avg({w}) {every}) ELSE {w} END")
        if scheme == "uniqueness":
            return {"weight": normal(unique)}
        if scheme == "return_attribution":
            return {"weight": normal(gained)}
        return {"weight": normal(s.let(f"{normal(unique)} * {normal(gained)}"))}

    return labels.steps(build)


def labelled(bars: Rel, config) -> Rel:
    """Labels and weights by a LabelConfig."""
    if config.scheme == "fixed_horizon":
        out = fixed_horizon(bars, config.horizon, config.deadband, config.three_class)
    elif config.scheme == "triple_barrier":
        out = triple_barrier(bars, config.horizon, config.pt_mult, config.sl_mult, config.atr_window)
    else:
        out = trend_scanning(bars, config.min_window, config.max_window, config.window_step)
    return weights(out, config.max_horizon, config.weighting)


def class_balance(labels: Rel) -> Rel:
    """Count and share of each class, the largest share, and whether it is over 0.65."""
    n = labels.where("label IS NOT NULL").agg(["instrument", "label"], n="count(*)")
    share = n.steps(lambda s: {"share": f"n / cast({(t := s.let('sum(n) OVER (PARTITION BY instrument)'))} as double)", "dominant": f"{s.let('max(n) OVER (PARTITION BY instrument)')} / cast({t} as double)"})
    return share.steps(lambda s: {"imbalanced": "dominant > 0.65"})


def barrier_shares(labels: Rel) -> Rel:
    n = labels.where("barrier IS NOT NULL").agg(["instrument", "barrier"], n="count(*)")
    return n.steps(lambda s: {"share": f"n / cast({s.let('sum(n) OVER (PARTITION BY instrument)')} as double)"})
