"""The log of experiments: append-only runs with their returns, and the leaderboard over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.relation import Rel
from tidegauge.operators import metrics as mt

# The columns of a leaderboard, in order.
LEADERBOARD = [
    "run_id", "timestamp", "ticker", "interval", "model_family", "label_scheme", "label_horizon", "n_features", "wf_mode", "wf_train", "wf_test", "wf_embargo", "sizing", "direction",
    "m_sharpe", "dsr_now", "m_cagr", "m_max_drawdown", "m_calmar", "m_sortino", "m_hit_rate", "m_profit_factor", "m_n_trades", "m_turnover_annual", "m_avg_exposure", "oos_accuracy", "oos_logloss", "random_percentile",
    "m_bench_sharpe", "ret_skew", "ret_kurtosis", "sharpe_per_bar", "m_n_bars", "n_trials_at_run", "config_hash", "session_id",
]


class RunLog:
    """Two Parquet tables under one folder: runs, and returns by run_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, record: dict, returns: DataFrame) -> None:
        """A run and its returns (ts, ret); a run_id is logged once. Spark's commit makes each write whole or absent. Returns come first:
        where the run itself is not written any more, its id is still free, and logging it again replaces them."""
        if self._there("runs") and self.runs().where(F.col("run_id") == record["run_id"]).limit(1).count():
            raise ValueError(f"run {record['run_id']} is logged already")
        # all numbers are doubles, so that a column has one type whatever each run has in it
        kinds = {bool: T.BooleanType(), float: T.DoubleType()}
        record = {k: float(v) if type(v) is int else v for k, v in record.items()}
        schema = T.StructType([T.StructField(k, kinds.get(type(v), T.StringType()) if not hasattr(v, "isoformat") else T.TimestampNTZType()) for k, v in record.items() if v is not None])
        row = tuple(v if type(v) in kinds or hasattr(v, "isoformat") else str(v) for v in record.values() if v is not None)
        returns.select(F.lit(record["run_id"]).alias("run_id"), "ts", F.col("ret").cast("double").alias("ret")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.root}/returns")
        self.spark.createDataFrame([row], schema).write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame | None:
        """All runs; columns that a run lacks are null. None if there is no run yet."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/runs") if self._there("runs") else None

    def returns(self, run_ids: list[str]) -> DataFrame:
        """run_id, ts and ret of some runs; only their partitions are read."""
        return self.spark.read.parquet(f"{self.root}/returns").where(F.col("run_id").isin(run_ids))

    def returns_matrix(self, run_ids: list[str]) -> DataFrame:
        """A row for each time with a column for each run, null where it has none."""
        return self.returns(run_ids).groupBy("ts").pivot("run_id", run_ids).agg(F.first("ret"))


def trials(runs: DataFrame, ticker: str | None = None, interval: str | None = None, session: str | None = None) -> DataFrame:
    """The last run of every configuration, of one ticker, interval or session."""
    for name, value in (("ticker", ticker), ("interval", interval), ("session_id", session)):
        if value:
            runs = runs.where(F.col(name) == value)
    last = F.row_number().over(Window.partitionBy("config_hash").orderBy(F.col("timestamp").desc(), F.col("run_id").desc()))
    return runs.withColumn("__n", last).where("__n = 1").drop("__n")


def trial_facts(runs: Rel) -> Rel:
    """How many configurations were tried and the variance of their Sharpe ratios per bar."""
    last = runs.agg(["config_hash"], sr="max_by(sharpe_per_bar, timestamp)")
    return last.agg([], n_trials="count(*)", variance="coalesce(var_samp(sr), 0)")


def leaderboard(runs: DataFrame, ticker: str | None = None, interval: str | None = None) -> DataFrame:
    """Runs by Sharpe ratio, each with its probability against the best of all trials so far (dsr_now)."""
    for name, value in (("ticker", ticker), ("interval", interval)):
        if value:
            runs = runs.where(F.col(name) == value)
    facts = trial_facts(Rel(runs)).df.first()
    bar = mt.expected_max_sharpe(facts["n_trials"], facts["variance"] or 0.0)
    moment = lambda name, default: F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")), F.lit(default)) if name in runs.columns else F.lit(default)
    rows = runs.withColumns({"sr": F.col("sharpe_per_bar"), "n": F.col("m_n_bars").cast("double"), "skew": moment("ret_skew", 0.0), "kurt": moment("ret_kurtosis", 3.0)})
    scored = mt.psr_z(Rel(rows), f"cast({bar!r} as double)").df.withColumn("dsr_now", normal_cdf("z")).withColumn("n_trials_now", F.lit(facts["n_trials"]))
    return scored.select(*(c for c in LEADERBOARD if c in scored.columns), "n_trials_now").orderBy(F.col("m_sharpe").desc_nulls_last())


def pbo_across(log: RunLog, run_ids: list[str], n_blocks: int = 10, most: int = 2000) -> DataFrame:
    """pbo and n_combinations over the bars that all of these logged runs have; null for fewer than two runs."""
    spark = log.spark
    if len(run_ids) < 2:
        return spark.createDataFrame([(None, 0)], "pbo double, n_combinations long")
    number = F.array_position(F.array(*map(F.lit, run_ids)), F.col("run_id")).cast("long") - 1
    rows = log.returns(run_ids).where("ret is not null").select(number.alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), F.col("ret").alias("r"))
    full = rows.groupBy("pos").agg(F.count("*").alias("n")).where(F.col("n") == len(run_ids)).select("pos")
    return mt.pbo_share(mt.pbo(Rel(rows.join(full, "pos")), n_blocks, most, spark=spark)).df


def normal_cdf(z: str) -> F.Column:
    """The normal distribution function in the JVM: the continued fraction and series of erfc within 1.2e-7 (Numerical Recipes' rational fit)."""
    x = F.abs(F.col(z)) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the fit, from the constant term on.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for a in c[-2::-1]:
        poly = a + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(F.col(z) >= 0, 1 - tail).otherwise(tail)


def parallel_coordinates(board: DataFrame) -> DataFrame:
    """Numbers of a leaderboard with codes for model and label scheme in the order in which they first appear."""
    keep = ["wf_train", "wf_test", "wf_embargo", "label_horizon", "n_features", "m_turnover_annual", "m_avg_exposure", "oos_accuracy", "m_max_drawdown", "m_sharpe"]
    rows = board.withColumn("__i", F.row_number().over(Window.orderBy(F.col("m_sharpe").desc_nulls_last(), "run_id")))
    for name, code in (("model_family", "model_code"), ("label_scheme", "label_code")):
        first = rows.groupBy(name).agg(F.min("__i").alias("__f")).withColumn(code, F.dense_rank().over(Window.orderBy("__f")) - 1).drop("__f")
        rows = rows.join(F.broadcast(first), name)
    return rows.where("m_sharpe is not null").select(*(c for c in keep if c in rows.columns), "model_code", "label_code")


def is_new(runs: DataFrame | None, config_hash: str) -> bool:
    return runs is None or runs.where(F.col("config_hash") == config_hash).limit(1).count() == 0
