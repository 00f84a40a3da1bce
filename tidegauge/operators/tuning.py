"""Settings proposed by a tree-structured Parzen estimator: where good trials lie denser than the others."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Range:
    """All numbers from low to high, on a logarithmic scale or whole ones, if so said."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inside(self, value: float) -> float:
        """The place of a value in 0 to 1."""
        f = math.log if self.log else float
        low, high = self._ends(f)
        return min(1.0, max(0.0, (f(min(max(value, self.low), self.high)) - low) / (high - low)))

    def at(self, place: float) -> float | int:
        low, high = self._ends(math.log if self.log else float)
        value = low + place * (high - low)
        value = math.exp(value) if self.log else value
        return int(min(self.high, max(self.low, round(value)))) if self.whole else min(self.high, max(self.low, value))

    def _ends(self, f) -> tuple[float, float]:
        """Half a step more on both sides for whole numbers, so that the outer ones are as likely as others."""
        return (f(self.low - 0.5), f(self.high + 0.5)) if self.whole else (f(self.low), f(self.high))


class Parzen:
    """ask() for settings, tell() what they cost.

    The first `random` trials are drawn from the ranges. Later the best trials (a tenth, 25 at most) and all others each make a
    density for every parameter: normal kernels around the values that were tried, as wide as the gaps to their
    neighbours, and one over the whole range; or counts of choices, one more for each. Of `draws` settings from the
    density of the best that one is proposed for which it exceeds the others' most."""

    def __init__(self, space: dict[str, Range | list], seed: int, random: int = 10, draws: int = 24) -> None:
        self.space, self.random, self.draws = dict(sorted(space.items())), random, draws
        self.rng = np.random.default_rng(seed)
        self.trials: list[tuple[float, dict[str, Any]]] = []

    def tell(self, settings: dict[str, Any], cost: float) -> None:
        """Settings without a value for a parameter teach nothing about it. A trial that failed costs infinity."""
        self.trials.append((cost, settings))

    def ask(self) -> dict[str, Any]:
        if len(self.trials) < self.random:
            return {n: s.at(self.rng.random()) if isinstance(s, Range) else s[self.rng.integers(len(s))] for n, s in self.space.items()}
        order = sorted(range(len(self.trials)), key=lambda i: self.trials[i][0])
        n_best = min(25, max(1, math.ceil(0.1 * len(order))))
        good, bad = ([self.trials[i][1] for i in part] for part in (order[:n_best], order[n_best:]))
        return {n: self._one(s, *([t[n] for t in part if n in t] for part in (good, bad))) for n, s in self.space.items()}

    def _one(self, space: Range | list, good: list, bad: list) -> Any:
        if not isinstance(space, Range):
            of_good, of_bad = (np.array([1.0 + sum(v == c for v in part) for c in space]) for part in (good, bad))
            drawn = self.rng.choice(len(space), self.draws, p=of_good / of_good.sum())
            return space[drawn[np.argmax((of_good / of_good.sum() / (of_bad / of_bad.sum()))[drawn])]]
        a, b = (self._kernels([space.inside(v) for v in part]) for part in (good, bad))
        which = self.rng.integers(len(a[0]), size=self.draws)
        x = self._within(a[0][which], a[1][which])
        return space.at(float(x[np.argmax(self._log_density(x, *a) - self._log_density(x, *b))]))

    @staticmethod
    def _kernels(values: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths; the first covers the range."""
        v = np.sort(np.array(values, float))
        gaps = np.diff(np.r_[0.0, v, 1.0])
        width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, len(v) + 2), 1.0)
        return np.r_[0.5, v], np.r_[1.0, width]

    def _within(self, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Normal draws, drawn again while they lie outside."""
        x = self.rng.normal(centre, width)
        while (out := (x < 0) | (x > 1)).any():
            x[out] = self.rng.normal(centre[out], width[out])
        return x

    @staticmethod
    def _log_density(x: np.ndarray, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
        phi = np.vectorize(lambda t: 0.5 * (1 + math.erf(t / math.sqrt(2))))
        mass = phi((1 - centre) / width) - phi(-centre / width)
        each = np.exp(-0.5 * ((x[:, None] - centre) / width) ** 2) / (width * mass)
        return np.log(each.mean(axis=1) + 1e-300)
