"""The engine's queries by name, each with its SQL where SQL can express it.

The tables hold no prices, so bars are made of orders and events: daily bars of all orders (`ALL`), daily bars by
order status, and hourly bars by type of event. Values are rounded where engines may differ in the last digit.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel
from tidegauge.functions.shared import shared_dir
from tidegauge.functions.steps import Steps
from tidegauge.operators import backtest as bt
from tidegauge.operators import diagnostics as dg
from tidegauge.operators import features as ft
from tidegauge.operators import folds as fo
from tidegauge.operators import information as im
from tidegauge.operators import labels as lb
from tidegauge.operators import metrics as mt
from tidegauge.operators import models as md
from tidegauge.operators import rules
from tidegauge.operators import shap as sh
from tidegauge.plans import experiment as ex
from tidegauge.plans.config import EnsembleConfig, ExperimentConfig, FeatureConfig, FeatureSpec, LabelConfig, MetaConfig, ModelConfig, WalkForwardConfig
from tidegauge.sources import bars as br
from tidegauge.sources import runs as rl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# bars


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return br.build(orders, F.lit("ALL"), F.col("o_orderdate"), 100 + F.col("o_totalprice") / 1e5, F.col("o_orderkey"))


def bars_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return br.build(orders, F.col("o_orderstatus"), F.col("o_orderdate"), 100 + F.col("o_totalprice") / 1e5, F.col("o_orderkey"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return br.build(events, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), 100 + F.col("value") / 100, F.col("event_id"))


def _bars_sql(instrument: str, ts: str, price: str, order: str, table: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS pos FROM (SELECT {instrument} AS instrument, {ts} AS ts, arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, {order}) AS close, count(*)::DOUBLE AS volume FROM {table} GROUP BY ALL))"


DAILY = _bars_sql("'ALL'", "o_orderdate", "100 + o_totalprice / 1e5", "o_orderkey", "orders")
STATUS = _bars_sql("o_orderstatus", "o_orderdate", "100 + o_totalprice / 1e5", "o_orderkey", "orders")
HOURLY = _bars_sql("event_type", "date_trunc('hour', ts)::TIMESTAMP", "100 + value / 100", "event_id", "events")
BAR_COLUMNS = "instrument, ts, pos, open, high, low, close, volume"

query("bars_daily", f"SELECT {BAR_COLUMNS} FROM {DAILY}")(bars_daily)
query("bars_status_panel", f"SELECT {BAR_COLUMNS} FROM {STATUS}")(bars_status)
query("bars_hourly_panel", f"SELECT {BAR_COLUMNS} FROM {HOURLY}")(bars_hourly)


# steps as queries


def rounded(e: str, digits: int = 6) -> str:
    return f"round(cast({e} as double), {digits}) + 0.0"


def by_steps(name: str, build: Callable[[Steps], dict[str, str]], source: Query = bars_status, source_sql: str = STATUS, keep: tuple[str, ...] = ("instrument", "pos"), digits: int = 6, plain: tuple[str, ...] = (), where: str = "") -> None:
    """A query whose operator is steps over a bar table; its SQL is the same operator written for the other dialect."""

    def outputs(s: Steps) -> dict[str, str]:
        return {k.replace(".", "_"): (e if k in plain else rounded(e, digits)) for k, e in build(s).items()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Steps()
        out = outputs(s)
        df = s.over(source(spark, sf_dir), out, list(keep))
        return df.where(where) if where else df

    s = Steps("duckdb")
    out = outputs(s)
    text = s.sql(source_sql, out, list(keep))
    query(name, f"SELECT * FROM ({text}) WHERE {where}" if where else text)(run)


for _name, _feature in ft.REGISTRY.items():
    if not _feature.extra.get("by_series"):
        by_steps(f"feat_{_name}", lambda s, n=_name: {f"{n}_{k}" if k else n: e for k, e in ft.columns(s, n).items()})

for _how in ft.TRANSFORMS[1:]:
    by_steps(f"tf_{_how}", lambda s, h=_how: {h: ft.transformed(s, ft.columns(s, "sma_ratio" if h != "log" else "natr", {"window": 10})[""], h, 40)})


# data quality


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by the day as if each were a bar that came again later: several bars a day, some without a close."""
    o = _table(spark, sf_dir, "orders")
    px = 100 + F.col("o_totalprice") / 1e5
    return o.select(F.col("o_orderstatus").alias("instrument"), F.col("o_orderdate").alias("ts"), *(px.alias(c) for c in ("open", "high", "low")), F.when(F.col("o_orderkey") % 7 != 0, px).alias("close"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq"))


@query(
    "clean_bars",
    f"SELECT {BAR_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS pos FROM (SELECT o_orderstatus AS instrument, o_orderdate AS ts, p AS open, p AS high, p AS low, CASE WHEN o_orderkey % 7 <> 0 THEN p END AS close, 1.0::DOUBLE AS volume FROM (SELECT *, 100 + o_totalprice / 1e5 AS p FROM orders) QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderdate ORDER BY o_orderkey DESC) = 1) WHERE close IS NOT NULL)",
)
def clean_bars(spark, sf_dir):
    return br.cleaned(_dirty(spark, sf_dir), "seq").select(*BAR_COLUMNS.split(", "))


@query(
    "integrity_counts",
    f"""SELECT instrument, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (WHERE volume <= 0) AS no_volume,
      count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS with_missing, 0::BIGINT AS out_of_order,
      count(*) FILTER (WHERE open <= 0) + count(*) FILTER (WHERE high <= 0) + count(*) FILTER (WHERE low <= 0) + count(*) FILTER (WHERE close <= 0) AS prices_not_positive,
      count(*) FILTER (WHERE high < low OR close > high OR close < low OR open > high OR open < low) AS ohlc_violations FROM {STATUS} GROUP BY instrument""",
)
def integrity_counts(spark, sf_dir):
    return br.integrity(bars_status(spark, sf_dir))


_Z = f"(SELECT *, (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w AS z FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY pos)) AS ret FROM {STATUS}) WINDOW w AS (PARTITION BY instrument))"


@query("price_gaps", f"SELECT instrument, ts, round(ret, 6) + 0.0 AS ret, round(z, 6) + 0.0 AS z FROM {_Z} WHERE abs(z) > 2.0")
def price_gaps(spark, sf_dir):
    return br.price_gaps(bars_status(spark, sf_dir), 2.0).select("instrument", "ts", (F.round("ret", 6) + 0.0).alias("ret"), (F.round("z", 6) + 0.0).alias("z"))


@query("bad_ticks", f"SELECT instrument, ts, round(ret, 6) + 0.0 AS ret, round(next_ret, 6) + 0.0 AS next_ret FROM (SELECT *, lead(ret) OVER (PARTITION BY instrument ORDER BY pos) AS next_ret FROM {_Z}) WHERE abs(z) > 1.0 AND sign(ret) = -sign(next_ret) AND abs(ret + next_ret) < 0.25 * abs(ret)")
def bad_ticks(spark, sf_dir):
    return br.bad_ticks(bars_status(spark, sf_dir), 1.0).select("instrument", "ts", (F.round("ret", 6) + 0.0).alias("ret"), (F.round("next_ret", 6) + 0.0).alias("next_ret"))


@query(
    "missing_days",
    f"""WITH b AS (SELECT * FROM {STATUS}), s AS (SELECT instrument, day::DATE AS day, row_number() OVER (PARTITION BY instrument ORDER BY day) AS slot FROM (SELECT instrument, unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM b GROUP BY instrument) WHERE isodow(day) < 6),
      a AS (SELECT *, slot - row_number() OVER (PARTITION BY instrument ORDER BY slot) AS run FROM s ANTI JOIN (SELECT instrument, ts::DATE AS day FROM b) USING (instrument, day))
      SELECT instrument, day FROM (SELECT *, count(*) OVER (PARTITION BY instrument, run) AS n FROM a) WHERE n > 1""",
)
def missing_days(spark, sf_dir):
    return br.missing_days(bars_status(spark, sf_dir), "1d", 1)


@query("longest_gap", f"SELECT instrument, median(gap) AS median_gap_s, max(gap) / nullif(median(gap), 0) AS longest_in_medians, arg_max(ts, (gap, -epoch_us(ts))) AS gap_start FROM (SELECT *, epoch(lead(ts) OVER (PARTITION BY instrument ORDER BY ts)) - epoch(ts) AS gap FROM {STATUS}) WHERE gap IS NOT NULL GROUP BY instrument")
def longest_gap(spark, sf_dir):
    return br.longest_gap(bars_status(spark, sf_dir))


# operators on relations: one definition for both engines


def by_relation(name: str, build: Callable[[Rel], Rel], source: Query = bars_status, source_sql: str = STATUS, spark_only: bool = False) -> None:
    query(name, None if spark_only else build(Rel(source_sql)).sql)(lambda spark, sf_dir: build(Rel(source(spark, sf_dir))).df)


def _labels(r: Rel, scheme: str) -> Rel:
    return {"fixed": lambda: lb.fixed_horizon(r, 5), "three": lambda: lb.fixed_horizon(r, 5, 0.01, True), "barrier": lambda: lb.triple_barrier(r, 10, 1.0, 1.0), "trend": lambda: lb.trend_scanning(r, 5, 12)}[scheme]()


KEY = ["instrument", "pos"]
for _name, _scheme, _more in (("label_fixed_binary", "fixed", []), ("label_fixed_3class", "three", []), ("label_triple_barrier", "barrier", ["barrier"])):
    by_relation(_name, lambda r, c=_scheme, m=_more: _labels(r, c).rounded("ret", keep=[*KEY, "label", "t1", "t1_pos", *m]))
by_relation("label_trend_scanning", lambda r: _labels(r, "trend").rounded("ret", "t_value", digits=4, keep=[*KEY, "label", "trend_window", "t1", "t1_pos"]))
by_relation("class_balance", lambda r: lb.class_balance(_labels(r, "three")).rounded("share", "dominant", keep=["instrument", "label", "n", "imbalanced"]))
by_relation("barrier_shares", lambda r: lb.barrier_shares(_labels(r, "barrier")).rounded("share", keep=["instrument", "barrier", "n"]))
by_relation("concurrency", lambda r: lb.concurrency(_labels(r, "barrier"), 10).select(*KEY, "concurrency"))
for _w in ("uniqueness", "return_attribution", "both"):
    by_relation(f"weight_{_w}", lambda r, w=_w: lb.weights(_labels(r, "barrier"), 10, w).rounded("weight", keep=KEY))

# features as a model sees them


SPECS = [FeatureSpec("rsi", {"window": 14}), FeatureSpec("natr", {"window": 14}), FeatureSpec("momentum", {"window": 10}, "zscore", 60), FeatureSpec("stochastic", {"k": 14, "d": 3}, "rank", 40)]


def _matrix(r: Rel) -> tuple[Rel, list[str]]:
    names = [c for c in ft.matrix(Steps(), SPECS)]
    return r.steps(lambda s: ft.matrix(s, SPECS)), names


by_relation("feature_matrix", lambda r: (m := _matrix(r))[0].rounded(*m[1], keep=KEY))
by_relation("warmup_trim", lambda r: fo.trimmed((m := _matrix(r))[0], m[1]).rounded(*m[1], keep=KEY))
by_relation("leak_correlation", lambda r: fo.label_correlation(lb.fixed_horizon((m := _matrix(r))[0], 5), m[1]).rounded("correlation", keep=["instrument", "feature", "n_pairs"]))

# walk-forward


FOLD_COLUMNS = ["instrument", "fold_id", "train_first", "train_last", "test_first", "test_last"]
WINDOWS = (750, 250, 250, 5)


def _membership(r: Rel, mode: str) -> Rel:
    return fo.members(lb.fixed_horizon(r, 5), fo.fold_ranges(r, mode, *WINDOWS))


#: Written by hand from what folds are: the i-th trains up to 750 + 250 i and tests from 5 later on.
FOLDS_SQL = f"""WITH b AS (SELECT *, lead(ts, 5) OVER (PARTITION BY instrument ORDER BY ts) AS t1, lead(pos, 5) OVER (PARTITION BY instrument ORDER BY ts) AS t1_pos FROM {STATUS}),
  n AS (SELECT instrument AS of, count(*) AS n FROM b GROUP BY instrument),
  f AS (SELECT of, i AS fold_id, CASE WHEN '{{mode}}' = 'expanding' THEN 0 ELSE 250 * i END AS train_start, 750 + 250 * i AS train_end, 755 + 250 * i AS test_start, least(n, 1005 + 250 * i) AS test_end FROM n, generate_series(0, 1000) AS g(i) WHERE 755 + 250 * i < n),
  m AS (SELECT b.instrument, b.pos, b.ts, f.fold_id, CASE WHEN b.pos >= f.test_start THEN 'test' ELSE 'train' END AS role FROM b JOIN f ON f.of = b.instrument WHERE b.pos >= f.test_start AND b.pos < f.test_end OR b.pos >= f.train_start AND b.pos < f.train_end AND b.t1_pos < f.test_start)
"""
_TIMES = ", ".join(f"{g}(ts) FILTER (WHERE role = '{role}') AS {role}_{name}" for role in ("train", "test") for g, name in (("min", "first"), ("max", "last")))
for _mode in ("rolling", "expanding"):
    query(f"folds_{_mode}", f"{FOLDS_SQL.format(mode=_mode)} SELECT instrument, fold_id, {_TIMES}, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test FROM m GROUP BY instrument, fold_id")(
        lambda spark, sf_dir, m=_mode: fo.summary(_membership(Rel(bars_status(spark, sf_dir)), m)).select(*FOLD_COLUMNS, n_train="cast(n_train as bigint)", n_test="cast(n_test as bigint)").df
    )
query("fold_membership_purged", f"{FOLDS_SQL.format(mode='rolling')} SELECT instrument, pos, fold_id, role FROM m")(lambda spark, sf_dir: _membership(Rel(bars_status(spark, sf_dir)), "rolling").select(*KEY, "fold_id", "role").df)


@query("n_folds", f"SELECT instrument, (count(*) - 756) // 250 + 1 AS n_folds FROM {STATUS} GROUP BY instrument HAVING count(*) > 755")
def n_folds(spark, sf_dir):
    return fo.fold_ranges(Rel(bars_status(spark, sf_dir)), "rolling", *WINDOWS).agg(["of"], n_folds="count(*)").select("n_folds", instrument="of").df


# backtests of a rule


def ruled(r: Rel, rule: str = "score") -> Rel:
    """p_long and p_short by a rule: the standard score of the close, squashed; or a primary rule's side."""

    def build(s: Steps) -> dict[str, str]:
        if rule == "score":
            z = s.let(ft.z(s, "close", 20))
            p = s.let(f"1 / (1 + exp({z}))")
            return {"p_long": p, "p_short": f"1 - {p}"}
        side = s.let(rules.side(s, rule))
        return {"side": side, "p_trade": f"CASE WHEN {side} <> 0 THEN {s.num(0.6)} END"}

    return r.steps(build)


def tested(r: Rel, scheme: str = "fixed_fractional", execution: str = "next_open", slippage_atr: float = 0.0) -> Rel:
    rows = bt.sized(bt.direction(ruled(r)), scheme)
    return bt.pnl(bt.targets(rows), execution, slippage_atr=slippage_atr)


for _rule in rules.RULES:
    by_relation(f"rule_{_rule}", lambda r, u=_rule: ruled(r, u).select(*KEY, "side", "p_trade"))
by_relation("signals_direction", lambda r: bt.direction(ruled(r)).select(*KEY, "want"))
by_relation("signals_direction_meta", lambda r: bt.direction(ruled(r, "momentum"), meta=True, allowed="long_only").select(*KEY, "want"))
for _s in ("vol_target", "kelly", "confidence"):
    by_relation(f"size_{_s}", lambda r, k=_s: bt.sized(bt.direction(ruled(r)), k).rounded("size", keep=KEY))
PNL = ["position", "gross", "cost", "net", "equity", "benchmark", "benchmark_equity"]
by_relation("bt_pnl_next_open", lambda r: tested(r).rounded(*PNL, keep=[*KEY, "reason"]))
by_relation("bt_pnl_close_to_close", lambda r: tested(r, execution="close_to_close").rounded(*PNL[:4], keep=KEY))
by_relation("bt_pnl_vol_target_atr_slippage", lambda r: tested(r, "vol_target", slippage_atr=0.1).rounded(*PNL, keep=KEY))
by_relation("trades", lambda r: bt.trades(tested(r)).rounded("avg_size", "pnl", keep=["instrument", "entry", "exit", "side", "bars_held", "reason"]))
by_relation("position_runs", lambda r: bt.position_runs(tested(r)).select("instrument", "run", "position", "length"))
by_relation("perf_table", lambda r: mt.performance(t := tested(r), bt.trades(t)).rounded(*mt.PERFORMANCE, digits=5, keep=["instrument"]))
by_relation("drawdown_stats", lambda r: mt.max_drawdown(tested(r)).rounded("max_drawdown", "drawdown_duration_bars", keep=["instrument"]))
by_relation("worst_month", lambda r: mt.worst_month(tested(r)).rounded("worst_month", keep=["instrument"]))
by_relation("alpha_beta", lambda r: mt.alpha_beta(tested(r)).rounded("alpha_annual", "beta", keep=["instrument"]))
by_relation("rolling_sharpe", lambda r: mt.rolling_sharpe(tested(r)).rounded("rolling_sharpe", digits=5, keep=KEY))
by_relation("psr_zscore", lambda r: mt.psr_z(mt.moments(tested(r))).rounded("sr", "skew", "kurt", "z", digits=5, keep=["instrument", "n"]))

STATE_SQL = f"""WITH RECURSIVE b AS (SELECT instrument, pos, want FROM {bt.direction(ruled(Rel(STATUS))).source}), w(instrument, pos, held, age, wait, reason) AS (
  SELECT instrument, -1::BIGINT, 0, 0, 0, NULL::VARCHAR FROM b GROUP BY instrument
  UNION ALL
  SELECT b.instrument, b.pos,
    CASE WHEN held <> 0 THEN CASE WHEN age + 1 >= 8 OR want <> held THEN 0 ELSE held END WHEN wait > 0 THEN 0 ELSE want END,
    CASE WHEN held <> 0 AND age + 1 < 8 AND want = held THEN age + 1 ELSE 0 END,
    CASE WHEN held <> 0 THEN CASE WHEN age + 1 >= 8 OR want <> held THEN 3 ELSE 0 END WHEN wait > 0 THEN wait - 1 ELSE 0 END,
    CASE WHEN held <> 0 THEN CASE WHEN age + 1 >= 8 THEN 'max_holding' WHEN want = 0 THEN 'signal' WHEN want <> held THEN 'flip' END END
  FROM w JOIN b ON b.instrument = w.instrument AND b.pos = w.pos + 1)
SELECT instrument, pos, held, reason FROM w WHERE pos >= 0"""


@query("bt_state_machine", STATE_SQL)
def bt_state_machine(spark, sf_dir):
    rows = bt.direction(ruled(Rel(bars_status(spark, sf_dir)))).df.select(*KEY, "want")
    return bt.walked_targets(rows, 3, 8).select(*KEY, "held", "reason")


def _series(r: Rel) -> Rel:
    """Returns of eight strategies over the same bars: one rule with windows of 5 to 40."""
    out = None
    for i, n in enumerate((5, 8, 10, 15, 20, 25, 30, 40)):

        def build(s: Steps, i=i, n=n) -> dict[str, str]:
            position = s.let(f"coalesce(lag(sign({ft.z(s, 'close', n)}), 1) OVER (PARTITION BY instrument ORDER BY pos), 0)")
            return {"series": str(i), "r": f"{position} * coalesce(close / {s.lag('close')} - 1, 0)"}

        one = r.steps(build, ["instrument", "pos"]).where("pos >= 60").select("series", "pos", "r")
        out = one if out is None else out.union(one)
    return out


query("pbo_combinations", mt.pbo(_series(Rel(DAILY)), 8).rounded("sr_in", "sr_out", "rank", "logit", keep=["combo", "series"]).sql)(lambda spark, sf_dir: mt.pbo(_series(Rel(bars_daily(spark, sf_dir))), 8, spark=spark).rounded("sr_in", "sr_out", "rank", "logit", keep=["combo", "series"]).df)
query("pbo_cscv", mt.pbo_share(mt.pbo(_series(Rel(DAILY)), 8)).rounded("pbo", keep=["n_combinations"]).sql)(lambda spark, sf_dir: mt.pbo_share(mt.pbo(_series(Rel(bars_daily(spark, sf_dir))), 8, spark=spark)).rounded("pbo", keep=["n_combinations"]).df)


RANDOM_SQL = f"""WITH b AS (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY pos) - 1 AS bar, position AS p, coalesce(benchmark, 0) AS r FROM {tested(Rel(STATUS)).source}),
m AS (SELECT *, CASE WHEN p IS NOT DISTINCT FROM lag(p) OVER (PARTITION BY instrument ORDER BY bar) THEN 0 ELSE 1 END AS new FROM b),
u AS (SELECT instrument, run, min(p) AS p, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY bar)::BIGINT AS run FROM m) GROUP BY ALL),
o AS (SELECT u.*, nth, CASE WHEN nth < 0 THEN '' ELSE md5(concat_ws('|', '0', instrument, nth::VARCHAR, run::VARCHAR)) END AS turn FROM u, generate_series(-1, 999) AS g(nth)),
l AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY instrument, nth ORDER BY turn, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM o),
e AS (SELECT instrument, nth, p, unnest(range(a, a + n)) AS bar FROM l),
w AS (SELECT e.instrument, nth, e.p * r - abs(e.p - coalesce(lag(e.p) OVER (PARTITION BY e.instrument, nth ORDER BY e.bar), 0)) * 6.5e-4 AS net FROM e JOIN b ON b.instrument = e.instrument AND b.bar = e.bar),
s AS (SELECT instrument, nth, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe FROM w GROUP BY ALL),
v AS (SELECT instrument, sharpe AS real FROM s WHERE nth < 0)
SELECT v.instrument, round(real, 6) + 0.0 AS real_sharpe, round(avg(sharpe), 6) + 0.0 AS random_mean, round(avg(CASE WHEN round(sharpe, 9) < round(real, 9) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS percentile, count(*) AS n_random
FROM v JOIN s ON s.instrument = v.instrument AND nth >= 0 GROUP BY v.instrument, real"""


@query("random_benchmark", RANDOM_SQL)
def random_benchmark(spark, sf_dir):
    return Rel(bt.random_benchmark(tested(Rel(bars_status(spark, sf_dir))).df, 6.5e-4)).rounded("real_sharpe", "random_mean", "percentile", keep=["instrument", "n_random"]).df


# diagnostics over the rule's predictions


def predicted(r: Rel) -> Rel:
    rows = ruled(lb.fixed_horizon(r, 5))
    return rows.steps(lambda s: {"y_true": "label", "y_pred": "CASE WHEN p_long > 0.5 THEN 1 WHEN p_long IS NOT NULL THEN -1 END"})


by_relation("confusion", lambda r: dg.confusion(predicted(r)))
by_relation("log_loss", lambda r: dg.log_loss(predicted(r), ["instrument"]).rounded("log_loss", "accuracy", "majority", keep=["instrument", "n"]))
by_relation("regime_perf", lambda r: dg.regimes(tested(r)).rounded("strategy_ann_return", "strategy_sharpe", "bench_ann_return", "bench_sharpe", digits=5, keep=["instrument", "regime_type", "regime", "n_bars"]))
by_relation("best_regime", lambda r: dg.best_regime(dg.regimes(tested(r))))
by_relation("acf", lambda r: dg.autocorrelation(r).rounded("acf", "bound", keep=["instrument", "lag"]))
by_relation("jarque_bera", lambda r: dg.jarque_bera(r).rounded("skew", "kurt", "jb", "p_value", digits=5, keep=["instrument", "n"]))
by_relation("returns_hist", lambda r: dg.histogram(r))
by_relation("label_drift", lambda r: dg.label_drift(lb.fixed_horizon(r, 5)).rounded("share", keep=KEY))
by_relation("corr_matrix", lambda r: dg.correlations((m := _matrix(r))[0], m[1]).rounded("correlation", keep=["instrument", "feature_a", "feature_b"]))
by_relation("cost_drag", lambda r: tested(r).agg(["instrument"], gross_sharpe=mt.sharpe_of("gross", 252.0), net_sharpe=mt.sharpe_of("net", 252.0), cost_annual="avg(cost) * 252").rounded("gross_sharpe", "net_sharpe", "cost_annual", digits=5, keep=["instrument"]))
by_relation("fold_perf", lambda r: tested(r).steps(lambda s: {"fold_id": "pos div 250" if s.spark else "pos // 250"}).agg(["instrument", "fold_id"], n="count(*)", strategy_return="exp(sum(ln(1 + net))) - 1", bench_return="exp(sum(ln(1 + benchmark))) - 1", sharpe=mt.sharpe_of("net", 252.0)).rounded("strategy_return", "bench_return", "sharpe", digits=5, keep=["instrument", "fold_id", "n"]))


def _runs(r: Rel) -> Rel:
    """A run log of the eight strategies, the first logged again later with one bar less."""
    per = mt.moments(_series(r), "r", "series")
    day = "make_date(2024, 1, cast(series as int) + 1)"
    first = per.select("series", "n", "sr", "skew", "kurt", config_hash="concat('c', cast(series as varchar(9)))", timestamp=day)
    again = per.where("series = 0").select("series", "skew", "kurt", n="n - 1", sr="sr * 0.9", config_hash="'c0'", timestamp="make_date(2024, 2, 1)")
    return first.union(again).steps(lambda s: {"sharpe_per_bar": "sr"})


by_relation("trial_dedupe", lambda r: rl.trial_facts(_runs(r)).rounded("variance", digits=9, keep=["n_trials"]), bars_daily, DAILY)
by_relation("leaderboard_z", lambda r: mt.psr_z(_runs(r), "cast(0.01 as double)").rounded("sr", "z", digits=5, keep=["config_hash", "timestamp", "n"]), bars_daily, DAILY)
by_relation("returns_pivot", lambda r: _series(r).agg(["pos"], **{f"run_{k}": f"max(CASE WHEN series = {k} THEN r END)" for k in range(8)}).rounded(*(f"run_{k}" for k in range(8)), keep=["pos"]), bars_daily, DAILY)

_CAL = predicted(Rel(STATUS))
query("calibration", f"WITH o AS (SELECT * FROM {_CAL.source} WHERE y_true IS NOT NULL AND p_long IS NOT NULL), e AS (SELECT {', '.join(f'quantile_cont(p_long, {i / 10}) AS e{i}' for i in range(1, 10))} FROM o) SELECT {' + '.join(f'CASE WHEN p_long > e{i} THEN 1 ELSE 0 END' for i in range(1, 10))} AS bin, round(avg(p_long), 6) + 0.0 AS mean_predicted, round(avg(CASE WHEN y_true = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 AS fraction_positive, count(*) AS n FROM o, e GROUP BY bin")(
    lambda spark, sf_dir: dg.calibration(predicted(Rel(bars_status(spark, sf_dir)))).rounded("mean_predicted", "fraction_positive", keep=["bin", "n"]).df
)


# models: they have no counterpart in SQL


SMALL = ExperimentConfig(
    features=FeatureConfig([FeatureSpec("momentum", {"window": 10}), FeatureSpec("price_ma_zscore", {"window": 20}), FeatureSpec("realised_vol", {"window": 20}), FeatureSpec("roc", {"window": 3})]),
    label=LabelConfig(horizon=5),
    walkforward=WalkForwardConfig(train_window=900, test_window=500, step=500, embargo=5),
)


def _walked(spark: SparkSession, sf_dir: str, label: LabelConfig | None = None, tries: int = 0, **model) -> tuple[ex.Dataset, md.Walk, ExperimentConfig]:
    config = replace(SMALL, model=ModelConfig(**model), label=label or SMALL.label, walkforward=replace(SMALL.walkforward, retune_per_fold=tries > 0, tune_iterations=max(1, tries)))
    ds = ex.prepare(bars_daily(spark, sf_dir), config)
    return ds, ex.walk(ds, config), config


MODELS: dict[str, dict] = {
    "wf_logreg_oos": {"family": "logreg", "params": {"l1_ratio": 0.0}},
    "wf_random_forest_oos": {"family": "random_forest", "params": {"n_estimators": 20}, "scaler": "none"},
    "wf_extra_trees_oos": {"family": "extra_trees", "params": {"n_estimators": 20}, "scaler": "robust"},
    "wf_boosted_oos": {"family": "xgboost", "params": {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1}},
    "wf_boosted_3class_oos": {"family": "xgboost", "params": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1}, "label": LabelConfig(horizon=5, deadband=0.01, three_class=True)},
    "wf_sequence_oos": {"family": "lstm", "params": {"seq_len": 5, "hidden_size": 8, "epochs": 8}},
    "wf_gru_oos": {"family": "gru", "params": {"seq_len": 5, "hidden_size": 8, "epochs": 8}},
    "wf_transformer_oos": {"family": "transformer", "params": {"seq_len": 5, "d_model": 8, "n_heads": 2, "n_layers": 1, "epochs": 8}},
    "wf_tuned_oos": {"family": "logreg", "params": {"max_iter": 20}, "tries": 3},
    "vote_soft": {"ensemble": EnsembleConfig(True, "soft", ["logreg", "random_forest"], {"random_forest": {"n_estimators": 10}})},
    "stacking": {"ensemble": EnsembleConfig(True, "stacking", ["logreg", "random_forest"], {"random_forest": {"n_estimators": 10}}, 3)},
    "vote_hard": {"ensemble": EnsembleConfig(True, "hard", ["logreg", "random_forest"], {"random_forest": {"n_estimators": 10}})},
    "wf_leafwise_oos": {"family": "lightgbm", "params": {"n_estimators": 20, "num_leaves": 7, "learning_rate": 0.1}},
    "meta_label": {"family": "logreg", "meta": MetaConfig(True, "momentum", {"window": 20})},
    "meta_label_model": {"family": "logreg", "meta": MetaConfig(True, "model", {}, "logreg", {"l1_ratio": 0.0})},
}
for _name, _model in MODELS.items():
    query(_name)(lambda spark, sf_dir, m=_model: _walked(spark, sf_dir, **m)[1].oos)


@query("evaluation")
def evaluation(spark, sf_dir):
    ds, w, config = _walked(spark, sf_dir, family="logreg")
    ev = ex.evaluate(ds, w, config, [0.01, 0.03, -0.02], n_random=200)
    return ev.folds


@query("perm_importance")
def perm_importance(spark, sf_dir):
    ds, w, _ = _walked(spark, sf_dir, family="logreg")
    return md.permutation_importance(w, ds.rows, ds.names)


class _Rule(md.Model):
    """A model that has nothing to learn: the less, the more the close is above its past."""

    def probabilities(self, rows, keep=md.KEYS):
        p = 1 / (1 + F.exp(F.col("z") + 20 * F.col("m")))
        return rows.select(*keep, (1 - p).alias("p_m1"), F.lit(0.0).alias("p_0"), p.alias("p_1"))


@query(
    "perm_importance_of_rule",
    f"""WITH b AS (SELECT *, close / lag(close, 10) OVER k - 1 AS m, (close - avg(close) OVER l) / nullif(stddev_samp(close) OVER l, 0) AS z, lead(close, 5) OVER k / close - 1 AS ret, (pos - 400) // 250 AS fold_id FROM {STATUS} WINDOW k AS (PARTITION BY instrument ORDER BY pos), l AS (PARTITION BY instrument ORDER BY pos ROWS 19 PRECEDING)),
      t AS (SELECT *, row_number() OVER (PARTITION BY instrument, fold_id ORDER BY pos) AS place, row_number() OVER (PARTITION BY instrument, fold_id ORDER BY md5('0|z|' || pos)) AS of_z, row_number() OVER (PARTITION BY instrument, fold_id ORDER BY md5('0|m|' || pos)) AS of_m FROM b WHERE pos >= 400),
      p AS (SELECT fold_id, ret, '' AS feature, z + 20 * m AS x FROM t UNION ALL SELECT a.fold_id, a.ret, 'z', b.z + 20 * a.m FROM t a JOIN t b ON a.instrument = b.instrument AND a.fold_id = b.fold_id AND a.place = b.of_z UNION ALL SELECT a.fold_id, a.ret, 'm', a.z + 20 * b.m FROM t a JOIN t b ON a.instrument = b.instrument AND a.fold_id = b.fold_id AND a.place = b.of_m),
      l AS (SELECT fold_id, feature, avg(-ln(greatest(CASE WHEN ret > 0 THEN 1 / (1 + exp(x)) ELSE 1 - 1 / (1 + exp(x)) END, 1e-15))) AS loss FROM p WHERE ret IS NOT NULL GROUP BY fold_id, feature)
      SELECT a.feature, round(avg(a.loss - b.loss), 6) + 0.0 AS importance, round(stddev_pop(a.loss - b.loss), 6) + 0.0 AS std FROM l a JOIN l b ON a.fold_id = b.fold_id AND b.feature = '' WHERE a.feature <> '' GROUP BY a.feature""",
)
def perm_importance_of_rule(spark, sf_dir):
    """Over all bars from 400 on, in blocks of 250, of which each is a test."""
    rows = lb.fixed_horizon(Rel(bars_status(spark, sf_dir)), 5).steps(lambda s: {"z": ft.z(s, "close", 20), "m": f"close / {s.lag('close', 10)} - 1"}).df
    last = rows.agg(F.max("pos")).first()[0]
    tests = [fo.Fold(i, 0, a - 5, a, a + 250) for i, a in enumerate(range(400, last + 1, 250))]
    walk = md.Walk(rows, tests, 0.0, models={f.fold_id: _Rule() for f in tests})
    return Rel(md.permutation_importance(walk, rows, ["z", "m"])).rounded("importance", "std", keep=["feature"]).df


@query("feat_hmm_state")
def feat_hmm_state(spark, sf_dir):
    return ft.feature(bars_daily(spark, sf_dir), "hmm_state", refit=400, min_train=500, n_iter=10)


_MI_ROWS = fo.trimmed(lb.fixed_horizon(Rel(DAILY).steps(lambda s: {k.replace(".", "_"): e for k, e in ft.matrix(s, SMALL.features.features).items()}), 5), _MI_NAMES := [k.replace(".", "_") for k in ft.matrix(Steps(), SMALL.features.features)])


def _information_sql(x: str) -> str:
    cuts = ", ".join(f"quantile_cont({x}, {i / 16}) AS c{i}" for i in range(1, 16))
    bin_ = " + ".join(f"CASE WHEN {x} > c{i} THEN 1 ELSE 0 END" for i in range(1, 16))
    return f"""SELECT '{x}' AS feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) + 0.0 AS information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY label) AS ny
      FROM (SELECT {bin_} AS b, label, count(*)::DOUBLE AS n FROM r, (SELECT {cuts} FROM r) WHERE {x} IS NOT NULL AND label IS NOT NULL GROUP BY ALL))"""


@query("mutual_information", f"WITH r AS (SELECT * FROM {_MI_ROWS.source}) " + " UNION ALL ".join(map(_information_sql, _MI_NAMES)))
def mutual_information(spark, sf_dir):
    ds = ex.prepare(bars_daily(spark, sf_dir), SMALL)
    return Rel(dg.mutual_information(ds.rows, ds.names)).rounded("information", keep=["feature"]).df


def _psi(n: str) -> str:
    """The digamma function of a whole number: the harmonic numbers."""
    return f"(coalesce(list_sum(list_transform(range(1, ({n})::BIGINT), lambda i: 1.0::DOUBLE / i)), 0) - 0.5772156649015329)"


#: Every value against every other.
_NEAREST_SQL = f"""WITH r AS (SELECT * FROM {_MI_ROWS.source} WHERE label IS NOT NULL AND {" AND ".join(f"{x} IS NOT NULL" for x in _MI_NAMES)}),
  v AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature, label AS y, pos AS id, {x}::DOUBLE AS x FROM r" for x in _MI_NAMES)}), t AS (SELECT feature, y, count(*) AS total FROM v GROUP BY feature, y HAVING count(*) > 1),
  s AS (SELECT v.*, total FROM v JOIN t USING (feature, y)), d AS (SELECT a.feature, a.id, any_value(a.x) AS x, any_value(a.total) AS total, list_sort(min(abs(a.x - b.x), 4))[least(3, any_value(a.total) - 1) + 1] AS r FROM s a JOIN s b ON a.feature = b.feature AND a.y = b.y GROUP BY a.feature, a.id),
  m AS (SELECT d.feature, d.id, any_value(d.total) AS total, count(*) AS m FROM d JOIN s ON s.feature = d.feature AND (abs(s.x - d.x) < d.r OR s.x = d.x) GROUP BY d.feature, d.id)
  SELECT feature, round(greatest(0, {_psi("count(*)")} + avg({_psi("least(3, total - 1)")} - {_psi("total")} - {_psi("m")})), 6) + 0.0 AS information FROM m GROUP BY feature"""


@query("mutual_information_nearest", _NEAREST_SQL)
def mutual_information_nearest(spark, sf_dir):
    ds = ex.prepare(bars_daily(spark, sf_dir), SMALL)
    return Rel(im.nearest(ds.rows, ds.names)).rounded("information", keep=["feature"]).df


@query(
    "kpss",
    f"""WITH b AS (SELECT instrument, pos, close - avg(close) OVER (PARTITION BY instrument) AS e FROM {STATUS}), l AS (SELECT ceil(12 * power(max(n) / 100.0, 0.25))::BIGINT AS l FROM (SELECT count(*) AS n FROM b GROUP BY instrument)),
      s AS (SELECT instrument, sum(w * w) AS eta, count(*) AS n FROM (SELECT instrument, sum(e) OVER (PARTITION BY instrument ORDER BY pos) AS w FROM b) GROUP BY instrument),
      v AS (SELECT x.instrument, sum(CASE WHEN x.pos = y.pos THEN x.e * y.e ELSE 2 * (1 - (x.pos - y.pos) / (l + 1)) * x.e * y.e END) AS v FROM l, b x JOIN b y ON x.instrument = y.instrument AND y.pos BETWEEN x.pos - (SELECT l FROM l) AND x.pos GROUP BY x.instrument)
      SELECT instrument, round(eta / n / v, 6) + 0.0 AS statistic FROM s JOIN v USING (instrument)""",
)
def kpss(spark, sf_dir):
    return Rel(dg.kpss(bars_status(spark, sf_dir))).rounded("statistic", keep=["instrument"]).df


@query(
    "adf",
    f"""WITH d AS (SELECT instrument, pos, close - lag(close) OVER w AS dy, lag(close) OVER w AS y1 FROM {STATUS} WINDOW w AS (PARTITION BY instrument ORDER BY ts)), r AS (SELECT *, lag(dy) OVER (PARTITION BY instrument ORDER BY pos) AS d1 FROM d),
      m AS (SELECT instrument, count(*) AS n, var_pop(y1) AS yy, var_pop(d1) AS dd, covar_pop(y1, d1) AS yd, covar_pop(y1, dy) AS y, covar_pop(d1, dy) AS d, var_pop(dy) AS v FROM r WHERE d1 IS NOT NULL GROUP BY instrument),
      c AS (SELECT *, (y * dd - d * yd) / (yy * dd - yd * yd) AS b1, (d * yy - y * yd) / (yy * dd - yd * yd) AS b2 FROM m)
      SELECT instrument, round(b1 / sqrt((v - b1 * y - b2 * d) / (n - 3) / (yy - yd * yd / dd)), 4) + 0.0 AS statistic FROM c""",
)
def adf(spark, sf_dir):
    told = spark.createDataFrame([(r["instrument"], r["statistic"]) for r in dg.adf(bars_status(spark, sf_dir))], "instrument string, statistic double")
    return Rel(told).rounded("statistic", digits=4, keep=["instrument"]).df


@query("adf_best_lags")
def adf_best_lags(spark, sf_dir):
    return spark.createDataFrame([(r["instrument"], r["lags"], r["statistic"], r["p_value"], r["aic"]) for r in dg.adf_best(bars_status(spark, sf_dir))], "instrument string, lags long, statistic double, p_value double, aic double")


# operators that are called as they are, with SQL written by hand


def _window_sql(name: str, n: int, each: str, value: str, ready: str = "y.v") -> str:
    """A feature of the last n bars by joining every bar with them; c0 is the close before, v what each bar gives."""
    return f"""WITH b AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS c0 FROM {STATUS}), e AS (SELECT *, {each} FROM b)
      SELECT x.instrument, x.pos, round(CASE WHEN count({ready}) = {n} THEN {value} END, 6) + 0.0 AS {name} FROM e x JOIN e y ON y.instrument = x.instrument AND y.pos BETWEEN x.pos - {n - 1} AND x.pos GROUP BY x.instrument, x.pos"""


_K = 0.34 / (1.34 + 21 / 19)
SQL["feat_parkinson"] = _window_sql("parkinson", 20, "ln(high / low) AS v", "sqrt(sum(y.v * y.v) / 20 / (4 * ln(2)))")
SQL["feat_garman_klass"] = _window_sql("garman_klass", 20, "ln(high / low) ** 2 / 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS v", "sqrt(greatest(sum(y.v) / 20, 0))")
SQL["feat_yang_zhang"] = _window_sql("yang_zhang", 20, "ln(open / c0) AS v, ln(close / open) AS d, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs", f"sqrt(greatest(var_samp(y.v) + {_K!r} * var_samp(y.d) + {1 - _K!r} * avg(y.rs), 0))")
SQL["feat_cci"] = _window_sql("cci", 20, "(high + low + close) / 3 AS v", "(any_value(x.v) - avg(y.v)) / nullif(0.015 * list_avg(list_transform(list(y.v), lambda t: abs(t - list_avg(list(y.v))))), 0)").replace("list_transform(list(y.v), lambda t: abs(t - list_avg(list(y.v))))", "list_transform(list(y.v), lambda t: abs(t - avg(y.v)))")
SQL["feat_cmf"] = _window_sql("cmf", 20, "(2 * close - low - high) / nullif(high - low, 0) * volume AS v", "sum(y.v) / nullif(sum(y.volume), 0)")
SQL["feat_amihud"] = _window_sql("amihud", 20, "abs(close / c0 - 1) / nullif(close * volume, 0) AS v", "ln(avg(y.v) * 1e9 + 1e-12)")
SQL["feat_volume_z"] = _window_sql("volume_z", 20, "volume AS v", "(any_value(x.volume) - avg(y.v)) / nullif(stddev_samp(y.v), 0)")
SQL["feat_vwap_distance"] = _window_sql("vwap_distance", 20, "(high + low + close) / 3 * volume AS v", "any_value(x.close) * sum(y.volume) / nullif(sum(y.v), 0) - 1")
SQL["feat_realised_vol"] = _window_sql("realised_vol", 20, "ln(close / c0) AS v", "stddev_samp(y.v)")
SQL["feat_williams_r"] = _window_sql("williams_r", 14, "high AS v", "-100 * (max(y.high) - any_value(x.close)) / nullif(max(y.high) - min(y.low), 0)")
_RANGE_SQL = f"""WITH RECURSIVE b AS (SELECT *, greatest(high, coalesce(c0, high)) - least(low, coalesce(c0, low)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS c0 FROM {STATUS})),
  w(instrument, pos, y) AS (SELECT instrument, pos, tr FROM b WHERE pos = 0 UNION ALL SELECT b.instrument, b.pos, w.y + (b.tr - w.y) / 14 FROM w JOIN b ON b.instrument = w.instrument AND b.pos = w.pos + 1)"""
SQL["feat_atr"] = f"{_RANGE_SQL} SELECT instrument, pos, round(CASE WHEN pos >= 13 THEN y END, 6) + 0.0 AS atr FROM w"
SQL["feat_natr"] = f"{_RANGE_SQL} SELECT instrument, pos, round(CASE WHEN pos >= 13 THEN y / close END, 6) + 0.0 AS natr FROM w JOIN b USING (instrument, pos)"

# a rule's predictions from bar FROM on, evaluated as a walk would be
FROM = 400
RULED = replace(SMALL, backtest=replace(SMALL.backtest, costs=replace(SMALL.backtest.costs, slippage_atr_frac=0.1)))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[ex.Dataset, md.Walk, ex.Evaluation]:
    bars = bars_status(spark, sf_dir)
    rows = predicted(Rel(bars)).where(f"pos >= {FROM}").steps(lambda s: {"fold_id": f"(pos - {FROM}) div 250", "p_neutral": "cast(0 as double)"}).df
    oos = rows.select("instrument", "ts", "pos", "y_true", "p_long", "p_short", "p_neutral", "y_pred", "fold_id")
    ds, w = ex.Dataset(bars, [], bars), md.Walk(oos, [], 0.0)
    return ds, w, ex.evaluate(ds, w, RULED, [0.01, 0.03, -0.02], n_random=5)


_EVALUATED_SQL = f"""{_RANGE_SQL}, z AS (SELECT *, (close - avg(close) OVER k) / stddev_samp(close) OVER k AS z FROM b WINDOW k AS (PARTITION BY instrument ORDER BY pos ROWS 19 PRECEDING)),
  p AS (SELECT z.*, 1 / (1 + exp(z)) AS p_long, lead(close, 5) OVER (PARTITION BY instrument ORDER BY pos) / close - 1 AS ret, coalesce(lag(w.y / close) OVER (PARTITION BY instrument ORDER BY pos), 0) AS slip FROM z JOIN w USING (instrument, pos)),
  h AS (SELECT *, CASE WHEN p_long > 0.55 THEN 1 WHEN 1 - p_long > 0.55 THEN -1 ELSE 0 END AS want, CASE WHEN ret > 0 THEN 1 WHEN ret <= 0 THEN -1 END AS y_true FROM p WHERE pos >= {FROM}),
  q AS (SELECT *, coalesce(lag(want) OVER v, 0) AS position, coalesce(lag(want, 2) OVER v, 0) AS before, coalesce(lead(open) OVER v / open - 1, 0) AS earned, coalesce(close / lag(close) OVER v - 1, 0) AS benchmark, (pos - {FROM}) // 250 AS fold_id FROM h WINDOW v AS (PARTITION BY instrument ORDER BY pos)),
  net AS (SELECT *, position * earned - abs(position - before) * (0.00065 + 0.1 * slip) AS net FROM q)"""


@query(
    "evaluation_of_rule",
    f"""{_EVALUATED_SQL} SELECT instrument, fold_id, count(*) AS n, round(product(1 + net) - 1, 5) + 0.0 AS strategy_return, round(product(1 + benchmark) - 1, 5) + 0.0 AS bench_return, round(avg(net) / stddev_samp(net) * sqrt(252), 4) + 0.0 AS sharpe,
      round(-avg(CASE WHEN y_true = 1 THEN ln(p_long) WHEN y_true = -1 THEN ln(1 - p_long) END), 5) + 0.0 AS log_loss, round(avg(CASE WHEN y_true = CASE WHEN p_long > 0.5 THEN 1 ELSE -1 END THEN 1.0 WHEN y_true IS NOT NULL THEN 0.0 END), 5) + 0.0 AS accuracy FROM net GROUP BY instrument, fold_id""",
)
def evaluation_of_rule(spark, sf_dir):
    folds = _evaluated(spark, sf_dir)[2].folds
    return folds.select("instrument", "fold_id", "n", *((F.round(c, d) + 0.0).alias(c) for c, d in (("strategy_return", 5), ("bench_return", 5), ("log_loss", 5), ("accuracy", 5), ("sharpe", 4))))


@query("experiment_record", f"{_EVALUATED_SQL} SELECT instrument, 'logreg' AS model_family, 0.1::DOUBLE AS cost_slippage_atr, min(ts) AS oos_start, max(ts) AS oos_end, count(*) AS m_n_bars, round(avg(net) / stddev_samp(net), 5) + 0.0 AS sharpe_per_bar, round(avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS m_avg_exposure FROM net GROUP BY instrument")
def experiment_record(spark, sf_dir):
    ds, w, ev = _evaluated(spark, sf_dir)
    made = [ex.record(RULED, ds, w, ev, i) for i in sorted(ev.metrics)]
    rows = [(i, r["model_family"], r["cost_slippage_atr"], r["oos_start"], r["oos_end"], r["m_n_bars"], round(r["sharpe_per_bar"], 5) + 0.0, round(r["m_avg_exposure"], 5) + 0.0) for i, r in zip(sorted(ev.metrics), made, strict=True)]
    return spark.createDataFrame(rows, "instrument string, model_family string, cost_slippage_atr double, oos_start timestamp_ntz, oos_end timestamp_ntz, m_n_bars long, sharpe_per_bar double, m_avg_exposure double")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


#: Returns of the eight strategies by hand: a window, its standard score, the position of the bar before.
_SERIES_SQL = "WITH b AS (SELECT * FROM " + DAILY + "), s AS (" + " UNION ALL ".join(
    f"SELECT {i} AS series, pos, ts, coalesce(lag(sign((close - m) / nullif(sd, 0))) OVER (ORDER BY pos), 0) * coalesce(close / lag(close) OVER (ORDER BY pos) - 1, 0) AS r FROM (SELECT *, CASE WHEN pos >= {n - 1} THEN avg(close) OVER k END AS m, CASE WHEN pos >= {n - 1} THEN stddev_samp(close) OVER k END AS sd FROM b WINDOW k AS (ORDER BY pos ROWS {n - 1} PRECEDING))"
    for i, n in enumerate((5, 8, 10, 15, 20, 25, 30, 40))
) + "), r AS (SELECT * FROM s WHERE pos >= 60)"


def _logged(spark: SparkSession, sf_dir: str) -> rl.RunLog:
    """A log of the eight strategies; every other run has also an accuracy, and the runs a number of features that some leave open."""
    log, bars = rl.RunLog(spark, _folder(spark)), bars_daily(spark, sf_dir)
    series = _series(Rel(bars)).df.join(bars.select("pos", "ts"), "pos").cache()
    for r in mt.moments(Rel(series), "r", "series").df.collect():
        k = r["series"]
        record = {"run_id": f"run{k}", "timestamp": datetime(2024, 1, 1 + k), "ticker": "ALL", "interval": "1d", "model_family": "rule" if k % 3 else "other", "label_scheme": "none", "wf_train": 750, "config_hash": f"c{k}", "m_sharpe": r["sr"] * 252**0.5, "sharpe_per_bar": r["sr"], "ret_skew": r["skew"], "ret_kurtosis": r["kurt"], "m_n_bars": r["n"]}
        record |= {"oos_accuracy": 0.5} if k % 2 else {"oos_accuracy": 1}
        log.append(record, series.where(F.col("series") == k).select("ts", F.col("r").alias("ret")))
    series.unpersist()
    return log


def _phi(z: str) -> str:
    """The normal distribution function in SQL: Simpson's rule over 100 steps from 0."""
    h = f"(({z}) / 100)"
    return f"(0.5 + {h} / 3 * list_sum(list_transform(range(0, 101), lambda i: CASE WHEN i IN (0, 100) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * {h}, 2) / 2))) / sqrt(2 * pi()))"


_MOMENTS_SQL = f"{_SERIES_SQL}, m AS (SELECT series, count(*) AS n, avg(r) / stddev_samp(r) AS sr, (avg(r ** 3) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 AS skew, (avg(r ** 4) - 4 * avg(r) * avg(r ** 3) + 6 * avg(r) ** 2 * avg(r * r) - 3 * avg(r) ** 4) / var_pop(r) ** 2 AS kurt FROM r GROUP BY series)"
_BEST_OF_8 = mt.expected_max_sharpe(8, 1.0)
_Z_SQL = f"{_MOMENTS_SQL}, z AS (SELECT *, (sr - {_BEST_OF_8!r} * (SELECT stddev_samp(sr) FROM m)) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z0 FROM m)"


@query("leaderboard", f"{_Z_SQL} SELECT 'run' || series AS run_id, CASE WHEN series % 3 <> 0 THEN 'rule' ELSE 'other' END AS model_family, round(sr * sqrt(252), 5) + 0.0 AS m_sharpe, round({_phi('z')}, 4) + 0.0 AS dsr_now, n::DOUBLE AS m_n_bars, CASE WHEN series % 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS oos_accuracy, 8::BIGINT AS n_trials_now FROM z")
def leaderboard(spark, sf_dir):
    board = rl.leaderboard(_logged(spark, sf_dir).runs())
    return board.select("run_id", "model_family", F.round("m_sharpe", 5).alias("m_sharpe"), F.round("dsr_now", 4).alias("dsr_now"), "m_n_bars", "oos_accuracy", F.col("n_trials_now").cast("long").alias("n_trials_now"))


@query("run_log", f"{_MOMENTS_SQL} SELECT 'run' || series AS run_id, make_timestamp(2024, 1, series + 1, 0, 0, 0) AS timestamp, 'c' || series AS config_hash, 750.0::DOUBLE AS wf_train, n::DOUBLE AS m_n_bars, round(sr, 6) + 0.0 AS sharpe_per_bar, CASE WHEN series % 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS oos_accuracy FROM m")
def run_log(spark, sf_dir):
    return _logged(spark, sf_dir).runs().select("run_id", "timestamp", "config_hash", "wf_train", "m_n_bars", F.round("sharpe_per_bar", 6).alias("sharpe_per_bar"), "oos_accuracy")


@query("returns_matrix", f"{_SERIES_SQL} SELECT ts, " + ", ".join(f"round(max(r) FILTER (WHERE series = {k}), 6) + 0.0 AS run{k}" for k in range(8)) + " FROM r GROUP BY ts")
def returns_matrix(spark, sf_dir):
    names = [f"run{k}" for k in range(8)]
    return Rel(_logged(spark, sf_dir).returns_matrix(names)).rounded(*names, keep=["ts"]).df


query("pbo_across_runs", SQL["pbo_cscv"])(lambda spark, sf_dir: Rel(rl.pbo_across(_logged(spark, sf_dir), [f"run{k}" for k in range(8)], 8)).rounded("pbo", keep=["n_combinations"]).df)


@query("parallel_coordinates", f"{_MOMENTS_SQL}, o AS (SELECT *, CASE WHEN series % 3 <> 0 THEN 'rule' ELSE 'other' END AS f, row_number() OVER (ORDER BY sr DESC) AS i FROM m), c AS (SELECT f, row_number() OVER (ORDER BY min(i)) - 1 AS model_code FROM o GROUP BY f) SELECT 750.0::DOUBLE AS wf_train, round(sr * sqrt(252), 5) + 0.0 AS m_sharpe, CASE WHEN series % 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS oos_accuracy, model_code, 0::BIGINT AS label_code FROM o JOIN c USING (f)")
def parallel_coordinates(spark, sf_dir):
    made = rl.parallel_coordinates(rl.leaderboard(_logged(spark, sf_dir).runs()))
    return made.select("wf_train", F.round("m_sharpe", 5).alias("m_sharpe"), "oos_accuracy", F.col("model_code").cast("long").alias("model_code"), F.col("label_code").cast("long").alias("label_code"))


@query("deflated_sharpe", f"{_Z_SQL} SELECT series, round({_BEST_OF_8!r} * (SELECT stddev_samp(sr) FROM m), 6) + 0.0 AS sr0, round({_phi('z0')}, 4) + 0.0 AS psr, round({_phi('z')}, 4) + 0.0 AS dsr, {_phi('z')} >= 0.95 AS significant FROM z")
def deflated_sharpe(spark, sf_dir):
    facts = mt.moments(_series(Rel(bars_daily(spark, sf_dir))), "r", "series").df.collect()
    told = [(r["series"], mt.deflated_sharpe(r["sr"], r["n"], r["skew"], r["kurt"], [x["sr"] for x in facts])) for r in facts]
    return spark.createDataFrame([(int(k), round(d["sr0"], 6), round(d["psr"], 4), round(d["dsr"], 4), d["significant"]) for k, d in told], "series long, sr0 double, psr double, dsr double, significant boolean")


_QUANTILES = [NormalDist().inv_cdf(1 - 1 / 8), NormalDist().inv_cdf(1 - 1 / (8 * math.e))]


@query("expected_max_sharpe", f"{_MOMENTS_SQL} SELECT count(*)::BIGINT AS n_trials, round(stddev_samp(sr) * ((1 - 0.5772156649015329) * {_QUANTILES[0]!r} + 0.5772156649015329 * {_QUANTILES[1]!r}), 6) + 0.0 AS best FROM m")
def expected_max_sharpe(spark, sf_dir):
    """The Sharpe ratio to expect of the best of all logged runs if none had any skill."""
    n, variance = rl.trials(_logged(spark, sf_dir).runs(), "ALL", "1d").agg(F.count("*"), F.var_samp("sharpe_per_bar")).first()
    return spark.createDataFrame([(n, round(mt.expected_max_sharpe(n, variance), 6))], "n_trials long, best double")


@query(
    "partial_autocorrelation",
    f"""WITH r AS (SELECT instrument, pos, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY pos)) AS r FROM {STATUS}), d AS (SELECT instrument, pos, r - avg(r) OVER (PARTITION BY instrument) AS d FROM r WHERE r IS NOT NULL),
      a AS (SELECT x.instrument, sum(x.d * y.d) FILTER (WHERE y.pos = x.pos - 1) / sum(x.d * y.d) FILTER (WHERE y.pos = x.pos) AS a, sum(x.d * y.d) FILTER (WHERE y.pos = x.pos - 2) / sum(x.d * y.d) FILTER (WHERE y.pos = x.pos) AS b, sum(x.d * y.d) FILTER (WHERE y.pos = x.pos - 3) / sum(x.d * y.d) FILTER (WHERE y.pos = x.pos) AS c FROM d x JOIN d y ON x.instrument = y.instrument AND y.pos BETWEEN x.pos - 3 AND x.pos GROUP BY x.instrument)
      SELECT instrument, unnest([1, 2, 3]) AS lag, round(unnest([a, (b - a * a) / (1 - a * a), (a * a * a - 2 * a * b + a * b * b + c - a * a * c) / (1 - 2 * a * a + 2 * a * a * b - b * b)]), 6) + 0.0 AS pacf FROM a""",
)
def partial_autocorrelation(spark, sf_dir):
    acf: dict[str, list[float]] = {}
    for r in dg.autocorrelation(Rel(bars_status(spark, sf_dir)), 3).df.orderBy("instrument", "lag").collect():
        acf.setdefault(r["instrument"], []).append(r["acf"])
    return spark.createDataFrame([(k, i + 1, round(v, 6) + 0.0) for k, x in acf.items() for i, v in enumerate(dg.partial(x))], "instrument string, lag int, pacf double")


@query(
    "variance_inflation",
    f"""WITH c AS (SELECT corr(open, close) AS ab, corr(open, volume) AS ac, corr(close, volume) AS bc FROM {STATUS}), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
      SELECT unnest(['open', 'close', 'volume']) AS feature, round(unnest([(1 - bc * bc) / det, (1 - ac * ac) / det, (1 - ab * ab) / det]), 6) + 0.0 AS vif FROM d""",
)
def variance_inflation(spark, sf_dir):
    told = dg.variance_inflation(bars_status(spark, sf_dir), ["open", "close", "volume"])
    return spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in told.items()], "feature string, vif double")


@query("normal_curve", f"WITH r AS (SELECT instrument, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY pos)) AS r FROM {STATUS}), f AS (SELECT instrument, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY instrument) SELECT instrument, i::INT AS bin, round(n * 0.003 / (s * sqrt(2 * pi())) * exp(-power((-0.0585 + 0.003 * i - m) / s, 2) / 2), 4) + 0.0 AS expected FROM f, generate_series(0, 39) AS g(i)")
def normal_curve(spark, sf_dir):
    return dg.normal_curve(Rel(bars_status(spark, sf_dir))).rounded("expected", digits=4, keep=["instrument", "bin"]).df


by_relation("probability_by_class", lambda r: dg.probability_by_class(predicted(r)).rounded("p_long", keep=[*KEY, "true_class"]))
SQL["probability_by_class"] = f"SELECT instrument, pos, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS true_class, round(1 / (1 + exp(z)), 6) + 0.0 AS p_long FROM (SELECT *, lead(close, 5) OVER (PARTITION BY instrument ORDER BY pos) / close - 1 AS ret, (close - avg(close) OVER k) / nullif(stddev_samp(close) OVER k, 0) AS z FROM {STATUS} WINDOW k AS (PARTITION BY instrument ORDER BY pos ROWS 19 PRECEDING)) WHERE pos >= 19 AND ret IS NOT NULL AND z IS NOT NULL"


#: All features whose values are expressions, by column; and one that knows the next close.
_PROBED = {f"{n}_{k}" if k else n: (n, k) for n, f in ft.REGISTRY.items() if not f.extra.get("by_series") for k in ft.columns(Steps(), n)}


@query("future_spike", f"SELECT unnest({sorted(_PROBED)!r}) AS feature, 0::BIGINT AS changed UNION ALL SELECT 'knows_next', count(DISTINCT instrument)::BIGINT FROM {STATUS}")
def future_spike(spark, sf_dir):
    """How many values of each feature in the first half of the bars change when all bars of the second half do."""
    bars = bars_status(spark, sf_dir)

    middle = bars.agg(F.min("pos"), F.max("pos")).first()[1] // 2

    def build(group: str) -> Callable[[DataFrame], DataFrame]:
        def over(b: DataFrame) -> DataFrame:
            s = Steps()
            made = {name: e for n, f in ft.REGISTRY.items() if f.group == group and not f.extra.get("by_series") for k, e in ft.columns(s, n).items() for name in [f"{n}_{k}" if k else n]}
            return s.over(b, made or {"knows_next": s.lead("close")}, list(KEY))

        return over

    # a plan for each group of features: planning takes more than proportionally longer for more of them
    out = fo.changed_before(bars, build(""), middle)
    for group in dict.fromkeys(ft.REGISTRY[n].group for n, _ in _PROBED.values()):
        out = out.unionByName(fo.changed_before(bars, build(group), middle))
    return out


@query("bars_cached", f"SELECT instrument, ts, pos, open, high, low, close, volume FROM {DAILY}")
def bars_cached(spark, sf_dir):
    """Raw columns fetched once, normalised, kept, and read back; the second call has nothing to fetch with."""
    root, asked = _folder(spark), ("ALL", "1d", "1992-01-01", "1999-01-01")
    raw = bars_daily(spark, sf_dir).select(F.col("ts").alias("Date"), *(F.col(c).alias(f" {c.title()}") for c in ("open", "high", "low", "close", "volume")))
    br.load(spark, root, *asked, fetch=lambda *_: raw)
    return br.load(spark, root, *asked).select(*BAR_COLUMNS.split(", "))


@query("bars_adjusted", f"SELECT s.instrument, s.ts, s.close, d.close AS close_raw, round(s.close / d.close, 6) + 0.0 AS adj_factor FROM {STATUS} s LEFT JOIN {DAILY} d ON d.ts = s.ts AND s.instrument = 'F'")
def bars_adjusted(spark, sf_dir):
    raw = bars_daily(spark, sf_dir).withColumn("instrument", F.lit("F"))
    return Rel(br.adjusted(raw, bars_status(spark, sf_dir).select("instrument", "ts", "close"))).rounded("adj_factor", keep=["instrument", "ts", "close", "close_raw"]).df


# models again: explained, saved, and of kinds that have no query above


@query("tree_shap")
def tree_shap(spark, sf_dir):
    """Mean absolute values over the tests of all folds, by part of an ensemble and feature."""
    trees = {"random_forest": {"n_estimators": 10, "max_depth": 4}, "xgboost": {"n_estimators": 5, "max_depth": 3}, "extra_trees": {"n_estimators": 5, "max_depth": 3}}
    ds, w, _ = _walked(spark, sf_dir, ensemble=EnsembleConfig(True, "soft", ["logreg", *trees], trees))
    parts: dict[str, DataFrame] = {}
    for f in w.folds:
        test = ds.rows.where((F.col("pos") >= f.test_start) & (F.col("pos") < f.test_end))
        for name, values in sh.explained(w.models[f.fold_id], test, _folder(spark)):
            parts[name] = parts[name].unionByName(values) if name in parts else values
    out = None
    for name, values in parts.items():
        one = sh.importance(values).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("saved_model", f"SELECT i AS fold_id, true AS same FROM (SELECT count(*) - 21 AS n FROM {DAILY}), generate_series(0, 1000) AS g(i) WHERE 905 + 500 * i < n")
def saved_model(spark, sf_dir):
    """Whether each fold's model, saved and loaded, scores every bar as it did."""
    ds, w, _ = _walked(spark, sf_dir, ensemble=EnsembleConfig(True, "soft", ["random_forest", "xgboost"], {"random_forest": {"n_estimators": 5, "class_weight": "balanced"}, "xgboost": {"n_estimators": 2}}))
    told = []
    for f in w.folds:
        path = _folder(spark)
        w.models[f.fold_id].save(spark, path)
        a, b = (m.probabilities(ds.rows).select(*KEY, F.round("p_1", 9).alias("p")) for m in (w.models[f.fold_id], md.load(spark, path)))
        told.append((f.fold_id, a.count() > 0 and not a.exceptAll(b).count()))
    return spark.createDataFrame(told, "fold_id long, same boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["perf_table"](spark, sf_dir)
