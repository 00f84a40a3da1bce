"""Primary rules: the side that a simple rule takes, for a model to say whether to take it."""

from __future__ import annotations

from collections.abc import Callable

from tidegauge.functions.steps import Steps
from tidegauge.operators.features import ema, rsi_of


def ma_crossover(s: Steps, fast: int = 20, slow: int = 50) -> str:
    return f"coalesce(sign({ema(s, 'close', fast)} - {ema(s, 'close', slow)}), 0)"


def momentum(s: Steps, window: int = 20) -> str:
    return f"coalesce(sign(close / {s.lag('close', window)} - 1), 0)"


def rsi_extremes(s: Steps, window: int = 14, low: float = 30.0, high: float = 70.0) -> str:
    """Buys what has fallen, sells what has risen."""
    value = rsi_of(s, window)
    return f"CASE WHEN {value} < {s.num(low)} THEN {s.num(1.0)} WHEN {value} > {s.num(high)} THEN {s.num(-1.0)} ELSE {s.num(0.0)} END"


RULES: dict[str, Callable[..., str]] = {"ma_crossover": ma_crossover, "momentum": momentum, "rsi_extremes": rsi_extremes}


def side(s: Steps, rule: str, **params) -> str:
    """cast to double: -1, 0 or 1; 0 where the rule has no view."""
    if rule not in RULES:
        raise ValueError(f"there is no rule {rule}; there are {sorted(RULES)}")
    return f"cast({RULES[rule](s, **params)} as double)"
