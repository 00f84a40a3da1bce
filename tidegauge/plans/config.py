"""What an experiment is: a tree of settings that is checked, written as JSON and hashed."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import typing
from dataclasses import dataclass, field
from typing import Any, Literal


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


class _Checked:
    def _choices(self) -> None:
        """Every field that names its choices has one of them."""
        for name, hint in typing.get_type_hints(type(self)).items():
            if typing.get_origin(hint) is Literal:
                _need(getattr(self, name) in typing.get_args(hint), f"{name} must be one of {typing.get_args(hint)}, not {getattr(self, name)!r}")


# Names and defaults of fields are the format of stored experiments.


@dataclass
class DataConfig(_Checked):
    ticker: str = "^OMXS30"
    start: str = "2005-01-01"
    end: str = "2025-12-31"
    interval: Literal["1d", "1h", "1wk"] = "1d"
    force_refresh: bool = False

    def validate(self) -> None:
        self._choices()
        _need(bool(self.ticker.strip()), "the ticker is empty")
        _need(self.start < self.end, f"{self.start} is not before {self.end}")


@dataclass
class FeatureSpec(_Checked):
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    transform: Literal["raw", "zscore", "rank", "diff", "log"] = "raw"
    transform_window: int = 60

    def column_name(self) -> str:
        """Name and sorted parameters, joined by _, and the transform with its window."""
        base = "_".join([self.name, *(f"{k}{self.params[k]}" for k in sorted(self.params))])
        return base if self.transform == "raw" else f"{base}__{self.transform}{self.transform_window}"

    def validate(self) -> None:
        self._choices()
        _need(self.transform not in ("zscore", "rank") or self.transform_window >= 5, f"a window of {self.transform_window} is too short for {self.transform}")


@dataclass
class FeatureConfig(_Checked):
    features: list[FeatureSpec] = field(default_factory=list)

    def validate(self) -> None:
        names = [f.column_name() for f in self.features]
        _need(bool(names), "there are no features")
        _need(len(set(names)) == len(names), f"features occur twice: {sorted({n for n in names if names.count(n) > 1})}")
        for f in self.features:
            f.validate()


@dataclass
class LabelConfig(_Checked):
    scheme: Literal["fixed_horizon", "triple_barrier", "trend_scanning"] = "fixed_horizon"
    horizon: int = 5
    deadband: float = 0.0
    three_class: bool = False
    pt_mult: float = 2.0
    sl_mult: float = 1.0
    atr_window: int = 14
    min_window: int = 5
    max_window: int = 20
    window_step: int = 1
    weighting: Literal["none", "uniqueness", "return_attribution", "both"] = "uniqueness"

    @property
    def max_horizon(self) -> int:
        """How far ahead a label may look."""
        return self.max_window if self.scheme == "trend_scanning" else self.horizon

    def validate(self) -> None:
        self._choices()
        _need(self.horizon >= 1, "the horizon is a bar at least")
        _need(self.deadband >= 0, "the deadband is not negative")
        if self.scheme == "triple_barrier":
            _need(self.pt_mult > 0 and self.sl_mult > 0, "barriers lie some way off")
            _need(self.atr_window >= 2, "the range needs two bars")
        if self.scheme == "trend_scanning":
            _need(self.min_window >= 3 and self.max_window > self.min_window and self.window_step >= 1, "windows run from 3 at least to more, by a positive step")


@dataclass
class MetaConfig(_Checked):
    enabled: bool = False
    primary: str = "ma_crossover"
    primary_params: dict[str, Any] = field(default_factory=lambda: {"fast": 20, "slow": 50})
    primary_model: str = "logreg"
    primary_model_params: dict[str, Any] = field(default_factory=dict)


@dataclass
class EnsembleConfig(_Checked):
    enabled: bool = False
    method: Literal["soft", "hard", "stacking"] = "soft"
    members: list[str] = field(default_factory=lambda: ["logreg", "random_forest"])
    member_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    stacking_folds: int = 4


@dataclass
class ModelConfig(_Checked):
    family: str = "logreg"
    params: dict[str, Any] = field(default_factory=dict)
    scaler: Literal["standard", "robust", "none"] = "standard"
    imputer: Literal["median", "mean", "none"] = "median"
    meta: MetaConfig = field(default_factory=MetaConfig)
    ensemble: EnsembleConfig = field(default_factory=EnsembleConfig)

    def validate(self) -> None:
        self._choices()
        _need(bool(self.family), "the model has no family")


@dataclass
class WalkForwardConfig(_Checked):
    mode: Literal["rolling", "expanding"] = "rolling"
    train_window: int = 750
    test_window: int = 125
    step: int = 125
    embargo: int = 5
    i_know_what_i_am_doing: bool = False
    retune_per_fold: bool = False
    tune_iterations: int = 10

    def validate(self, label_horizon: int | None = None) -> None:
        self._choices()
        _need(self.train_window >= 50, "fewer than 50 bars are not enough to train on")
        _need(self.test_window >= 1 and self.step >= 1, "test and step are a bar at least")
        _need(self.embargo >= 0, "the embargo is not negative")
        _need(label_horizon is None or self.embargo >= label_horizon or self.i_know_what_i_am_doing, f"labels look {label_horizon} bars ahead, past an embargo of {self.embargo}")


@dataclass
class CostConfig(_Checked):
    commission_bps: float = 2.0
    spread_bps: float = 5.0
    slippage_bps: float = 2.0
    slippage_atr_frac: float = 0.0
    allow_zero_cost: bool = False

    def validate(self) -> None:
        costs = (self.commission_bps, self.spread_bps, self.slippage_bps, self.slippage_atr_frac)
        _need(min(costs) >= 0, "costs are not negative")
        _need(sum(costs) > 0 or self.allow_zero_cost, "trading without costs has to be allowed")


@dataclass
class SizingConfig(_Checked):
    scheme: Literal["fixed_fractional", "vol_target", "kelly", "confidence"] = "fixed_fractional"
    fixed_fraction: float = 1.0
    target_vol: float = 0.15
    vol_window: int = 20
    leverage_cap: float = 2.0
    kelly_max: float = 0.5
    kelly_window: int = 60
    confidence_floor: float = 0.5

    def validate(self) -> None:
        self._choices()
        _need(0 < self.fixed_fraction <= 10, "the fraction lies in (0, 10]")
        _need(self.target_vol > 0 and self.leverage_cap > 0, "target volatility and leverage are positive")
        _need(0 < self.kelly_max <= 1, "the Kelly share lies in (0, 1]")
        _need(self.vol_window >= 5 and self.kelly_window >= 10, "windows are 5 and 10 bars at least")


@dataclass
class BacktestConfig(_Checked):
    long_threshold: float = 0.55
    short_threshold: float = 0.55
    direction: Literal["long_only", "long_short", "short_only"] = "long_short"
    execution: Literal["next_open", "close_to_close"] = "next_open"
    cooldown: int = 0
    max_holding: int = 0
    costs: CostConfig = field(default_factory=CostConfig)
    sizing: SizingConfig = field(default_factory=SizingConfig)

    def validate(self) -> None:
        self._choices()
        _need(0 < self.long_threshold < 1 and 0 < self.short_threshold < 1, "thresholds lie in (0, 1)")
        _need(self.cooldown >= 0 and self.max_holding >= 0, "cooldown and holding are not negative")
        self.costs.validate()
        self.sizing.validate()


@dataclass
class ExperimentConfig(_Checked):
    seed: int = 42
    data: DataConfig = field(default_factory=DataConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    label: LabelConfig = field(default_factory=LabelConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    walkforward: WalkForwardConfig = field(default_factory=WalkForwardConfig)
    backtest: BacktestConfig = field(default_factory=BacktestConfig)

    def validate(self) -> None:
        for part in (self.data, self.features, self.label, self.model, self.backtest):
            part.validate()
        self.walkforward.validate(self.label.max_horizon)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, sort_keys=True, default=lambda o: o.item())

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ExperimentConfig:
        return _built(cls, d)

    @classmethod
    def from_json(cls, text: str) -> ExperimentConfig:
        return _built(cls, json.loads(text))

    def config_hash(self) -> str:
        """Of all but whether data is fetched anew, which makes no other strategy."""
        d = self.to_dict()
        d["data"].pop("force_refresh")
        return hashlib.sha256(json.dumps(d, sort_keys=True, default=lambda o: o.item()).encode()).hexdigest()[:16]


def _built(kind: Any, value: Any) -> Any:
    """A value of JSON as a field's type; keys that it does not know are refused."""
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        if unknown := set(value) - {f.name for f in dataclasses.fields(kind)}:
            raise ValueError(f"{kind.__name__} has no {sorted(unknown)}")
        return kind(**{k: _built(hints[k], v) for k, v in value.items()})
    if typing.get_origin(kind) is list:
        return [_built(typing.get_args(kind)[0], v) for v in value]
    return value
