"""An experiment from its configuration: dataset, walk through the folds, evaluation, record."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.operators import backtest as bt
from tidegauge.operators import diagnostics as dg
from tidegauge.operators import features as ft
from tidegauge.operators import folds as fo
from tidegauge.operators import labels as lb
from tidegauge.operators import metrics as mt
from tidegauge.operators import models as md
from tidegauge.plans.config import ExperimentConfig
from tidegauge.sources.bars import BARS_A_YEAR


def stage_keys(config: ExperimentConfig) -> dict[str, str]:
    """For dataset, walk and evaluation a hash of all settings that they depend on, those of the stages before included."""
    tree, parts, out = json.loads(config.to_json(None)), {}, {}
    for stage, names in (("dataset", ("data", "features", "label", "seed")), ("walk", ("walkforward", "model")), ("evaluation", ("backtest",))):
        parts |= {k: tree[k] for k in names}
        out[stage] = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]
    return out


class Stages:
    """Results of stages by their keys: a stage is made again once a setting changes that it, or one before it, depends on."""

    def __init__(self) -> None:
        self._kept: dict[str, tuple[str, Any]] = {}

    def get(self, stage: str, config: ExperimentConfig, make: Callable[[], Any]) -> Any:
        key = stage_keys(config)[stage]
        if self._kept.get(stage, ("",))[0] != key:
            self._kept[stage] = key, make()
        return self._kept[stage][1]


@dataclass
class Dataset:
    """Bars with shifted features and labels, trimmed to where all features are known."""

    rows: DataFrame
    names: list[str]
    bars: DataFrame


def prepare(bars: DataFrame, config: ExperimentConfig, stage: Callable[[DataFrame], DataFrame] = lambda df: df.cache(), features: Callable[[ft.Steps, list], dict[str, str]] = ft.matrix) -> Dataset:
    """One chain of windows over one exchange by instrument. `stage` keeps the result, which every fold reads.

    features: what makes the columns of the specs; they have to say that they are shifted, as those of ft.matrix do."""
    config.validate()
    specs = config.features.features
    s = ft.Steps()
    made = features(s, specs)
    plain = {name: name.replace(".", "_") for name in made}  # a dot would be read as a field
    featured = s.over(bars, {plain[k]: e for k, e in made.items()})
    fo.check_provenance(featured, list(plain.values()), bars)
    labelled = lb.labelled(Rel(featured), config.label)
    names = list(plain.values())
    rows = stage(fo.trimmed(labelled, names).df)
    fo.check_labels_in_features(Rel(rows), names)
    return Dataset(rows, names, bars)


def walk(ds: Dataset, config: ExperimentConfig, threads: int = 4, progress=None) -> md.Walk:
    """Folds over the trimmed rows' positions, and their predictions."""
    fo.check_provenance(ds.rows, ds.names, ds.bars)
    w = config.walkforward
    lo, hi = ds.rows.agg(F.min("pos"), F.max("pos")).first()
    made = fo.folds(hi - lo + 1, w.mode, w.train_window, w.test_window, w.step, w.embargo)
    fo.check_folds(made, w.mode, w.train_window, w.test_window, w.embargo)
    moved = [fo.Fold(f.fold_id, f.train_start + lo, f.train_end + lo, f.test_start + lo, f.test_end + lo) for f in made]
    m = config.model.meta
    by_model = lambda: md.family(m.primary_model, m.primary_model_params, config.seed, config.model.scaler, config.model.imputer)
    primary = None if not m.enabled else by_model if m.primary == "model" else (m.primary, m.primary_params)
    return md.walk_forward(ds.rows, ds.names, moved, lambda: md.build(config.model, config.seed), primary, threads, w.tune_iterations if w.retune_per_fold else 0, w.embargo, progress)


@dataclass
class Evaluation:
    """What a walk is worth: per instrument figures, luck, and folds."""

    result: DataFrame
    trades: DataFrame
    metrics: dict[str, dict[str, Any]]
    luck: dict[str, dict[str, float]]
    random: dict[str, dict[str, Any]]
    folds: DataFrame
    n_trials: int


def evaluate(ds: Dataset, w: md.Walk, config: ExperimentConfig, trial_sharpes: list[float] = (), n_trials: int | None = None, n_random: int = 1000) -> Evaluation:
    """Backtest over the bars from the first prediction on; bars without one are flat."""
    year, meta = BARS_A_YEAR[config.data.interval], config.model.meta.enabled
    first, last = w.oos.agg(F.min("pos"), F.max("pos")).first()
    named = ["p_long", "p_short", *(["side", "p_trade"] if meta else [])]
    # the range is of all bars, so that the first bars that are tested have one
    ranged = Rel(ds.bars).steps(lambda s: {"atr_share": bt.known_range(s, config.label.atr_window)}).df
    prices = ranged.where(F.col("pos").between(first, last)).join(w.oos.select("instrument", "pos", "fold_id", *named), ["instrument", "pos"], "left")
    result = bt.backtest(Rel(prices), config.backtest, year, meta, atr_share="atr_share").df.cache()
    trades = bt.trades(Rel(result)).df
    table = {r["instrument"]: r.asDict() for r in mt.performance(Rel(result), Rel(trades), year).df.collect()}
    luck = {r["instrument"]: mt.deflated_sharpe(r["sr"] or float("nan"), r["n"], r["skew"], r["kurt"], list(trial_sharpes), n_trials) | {"sharpe_per_bar": r["sr"], "skew": r["skew"], "kurtosis": r["kurt"]} for r in mt.moments(Rel(result)).df.collect()}
    c = config.backtest.costs
    random = {r["instrument"]: r.asDict() for r in bt.random_benchmark(result, (c.commission_bps + c.spread_bps / 2 + c.slippage_bps) / 1e4, year, n_random, config.seed).collect()}
    per_fold = Rel(result).where("fold_id IS NOT NULL").agg(["instrument", "fold_id"], n="count(*)", strategy_return=mt.grown("net"), bench_return=mt.grown("benchmark"), sharpe=mt.sharpe_of("net", year)).df
    folds = per_fold.join(dg.log_loss(Rel(w.oos), ["instrument", "fold_id"]).df.drop("n"), ["instrument", "fold_id"], "left")
    return Evaluation(result, trades, table, luck, random, folds, n_trials if n_trials is not None else len(trial_sharpes))


def family_label(config) -> str:
    """logreg, soft(logreg+random_forest), or meta[rule->family]."""
    first = config.meta.primary_model if config.meta.primary == "model" else config.meta.primary
    core = f"{config.ensemble.method}({'+'.join(config.ensemble.members)})" if config.ensemble.enabled else config.family
    return f"meta[{first}->{core}]" if config.meta.enabled else core


def record(config: ExperimentConfig, ds: Dataset, w: md.Walk, ev: Evaluation, instrument: str, session_id: str = "", run_id: str | None = None) -> dict[str, Any]:
    """The flat row of one instrument for the run log. Names are the format of the log."""
    span = w.oos.where(F.col("instrument") == instrument).agg(F.min("ts"), F.max("ts")).first()
    own, luck = ev.metrics[instrument], ev.luck[instrument]
    loss = ev.folds.where(F.col("instrument") == instrument).agg(F.avg("accuracy"), F.avg("log_loss")).first()
    wf, b, lab = config.walkforward, config.backtest, config.label
    out = {
        "run_id": run_id or uuid.uuid4().hex[:12], "session_id": session_id, "timestamp": datetime.now(UTC).replace(tzinfo=None), "ticker": config.data.ticker, "interval": config.data.interval, "start": config.data.start, "end": config.data.end,
        "oos_start": span[0], "oos_end": span[1], "config_hash": config.config_hash(), "config_json": config.to_json(None), "features": ",".join(ds.names), "n_features": len(ds.names), "label_scheme": lab.scheme, "label_horizon": lab.max_horizon,
        "model_family": family_label(config.model), "hyperparameters": json.dumps(config.model.params, sort_keys=True, default=str), "wf_mode": wf.mode, "wf_train": wf.train_window, "wf_test": wf.test_window, "wf_step": wf.step, "wf_embargo": wf.embargo, "wf_retune": wf.retune_per_fold, "n_folds": len(w.folds),
        "cost_commission_bps": b.costs.commission_bps, "cost_spread_bps": b.costs.spread_bps, "cost_slippage_bps": b.costs.slippage_bps, "cost_slippage_atr": b.costs.slippage_atr_frac, "sizing": b.sizing.scheme, "direction": b.direction, "execution": b.execution,
        "long_threshold": b.long_threshold, "short_threshold": b.short_threshold, "seed": config.seed, "n_trials_at_run": ev.n_trials, "sharpe_per_bar": luck["sharpe_per_bar"], "ret_skew": luck["skew"], "ret_kurtosis": luck["kurtosis"], "dsr": luck["dsr"], "psr": luck["psr"],
        "random_percentile": ev.random[instrument]["percentile"], "oos_accuracy": loss[0], "oos_logloss": loss[1], "wf_seconds": w.seconds,
    }
    return out | {f"m_{k}": own[k] for k in mt.PERFORMANCE}


def run(bars: DataFrame, config: ExperimentConfig, log=None, session_id: str = "", instrument: str | None = None) -> tuple[Dataset, md.Walk, Evaluation]:
    """All of it, logged once for the instrument if there is a log."""
    ds = prepare(bars, config)
    w = walk(ds, config)
    known = log.runs() if log else None
    from tidegauge.sources import runs as rl

    sharpes = [r["sharpe_per_bar"] for r in rl.trials(known, config.data.ticker, config.data.interval).select("sharpe_per_bar").collect()] if known is not None else []
    ev = evaluate(ds, w, config, sharpes, len(sharpes) + rl.is_new(known, config.config_hash()))
    if log:
        name = instrument or next(iter(ev.metrics))
        log.append(record(config, ds, w, ev, name, session_id), ev.result.where(F.col("instrument") == name).select("ts", F.col("net").alias("ret")))
    return ds, w, ev
