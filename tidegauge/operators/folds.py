"""Walk-forward folds by position, purging, and the guards against looking ahead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.relation import Rel


class LeakageError(AssertionError):
    """Something known only later would reach a model."""


@dataclass(frozen=True)
class Fold:
    """Half-open ranges of positions."""

    fold_id: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int


def folds(n: int, mode: str = "rolling", train: int = 750, test: int = 125, step: int = 125, embargo: int = 5) -> list[Fold]:
    """Folds over n bars: a test block begins `embargo` after its training block ends, and moves on by `step`."""
    if n < train + embargo + 1:
        raise ValueError(f"{n} bars are too few for {train} to train on, an embargo of {embargo} and a test")
    out, end = [], train
    while end + embargo < n:
        out.append(Fold(len(out), 0 if mode == "expanding" else end - train, end, end + embargo, min(n, end + embargo + test)))
        end += step
    return out


def fold_table(spark: SparkSession, made: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.fold_id, f.train_start, f.train_end, f.test_start, f.test_end) for f in made], "fold_id long, train_start long, train_end long, test_start long, test_end long")


def fold_ranges(bars: Rel, mode: str = "rolling", train: int = 750, test: int = 125, step: int = 125, embargo: int = 5) -> Rel:
    """The folds of every instrument over all of its bars, a row each (of, fold_id and the ranges); none where bars are too few."""
    n = bars.agg(["instrument"], n="max(pos) + 1")
    many = f"n - {train + embargo} > 0"
    div = bars.one("div", "//")
    last = f"(n - {train + embargo + 1}) {div} {step}"
    ids = bars.one(f"explode(sequence(0L, {last}))", f"unnest(generate_series(0, {last}))")
    each = n.where(many).select("n", of="instrument", fold_id=ids)
    end = f"({train} + fold_id * {step})"
    return each.select("of", "fold_id", train_start="cast(0 as bigint)" if mode == "expanding" else f"fold_id * {step}", train_end=end, test_start=f"{end} + {embargo}", test_end=f"least(n, {end} + {embargo + test})")


def members(rows: Rel, ranges: Rel, purge: bool = True) -> Rel:
    """fold_id and role (train, test) of each row; purged training rows, whose label is not known before the test, are left out."""
    known = " AND t1_pos IS NOT NULL AND t1_pos < test_start" if purge else ""
    own = "instrument = of AND " if not ranges.spark or "of" in ranges.df.columns else ""
    train = rows.between(ranges, f"{own}pos >= train_start AND pos < train_end{known}").steps(lambda s: {"role": "'train'"})
    return train.union(rows.between(ranges, f"{own}pos >= test_start AND pos < test_end").steps(lambda s: {"role": "'test'"}))


def summary(membership: Rel) -> Rel:
    """Of each fold how many rows train and test, and from when to when."""
    when = lambda f, role: f"{f}(CASE WHEN role = '{role}' THEN ts END)"
    return membership.agg(["instrument", "fold_id"], n_train="sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END)", n_test="sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END)", train_first=when("min", "train"), train_last=when("max", "train"), test_first=when("min", "test"), test_last=when("max", "test"))


def check_folds(made: list[Fold], mode: str, train: int, test: int, embargo: int) -> None:
    """Raises LeakageError where the geometry lets a test be seen."""
    if not made:
        raise LeakageError("there are no folds")
    for f in made:
        rules = [
            (f.train_end > f.train_start, "trains on nothing"),
            (f.test_end > f.test_start, "tests nothing"),
            (f.train_end <= f.test_start, "trains on its test"),
            (f.test_start - f.train_end >= embargo, "breaks the embargo"),
            (f.test_end - f.test_start <= test, "tests too much"),
            (mode == "expanding" or f.train_end - f.train_start <= train, "trains on too much"),
            (mode != "expanding" or f.train_start == 0, "does not train from the first bar"),
        ]
        for ok, text in rules:
            if not ok:
                raise LeakageError(f"fold {f.fold_id} {text}")
    if any(b.test_start <= a.test_start for a, b in zip(made, made[1:], strict=False)):
        raise LeakageError("test blocks do not move on")


def check_alignment(a: DataFrame, b: DataFrame) -> None:
    """Raises LeakageError where two tables are not over the same bars."""
    keys = ["instrument", "pos"]
    if a.select(*keys).exceptAll(b.select(*keys)).limit(1).count() or b.select(*keys).exceptAll(a.select(*keys)).limit(1).count():
        raise LeakageError("features and labels are over different bars")


def bars_hash(bars: DataFrame) -> str:
    """Names the bars that a table is over: how many, and a sum of hashes of their keys and times."""
    n, total = bars.agg(F.count("*"), F.sum(F.xxhash64("instrument", "pos", "ts").cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def marked(rows: DataFrame, names: list[str], bars: str, shift: int = 1) -> DataFrame:
    """Features that were made elsewhere with what check_feature_matrix asks for, as metadata of their columns."""
    return rows.select(*(F.col(c).alias(c, metadata={"shift": shift, "bars": bars}) if c in names else F.col(c) for c in rows.columns))


def check_provenance(rows: DataFrame, names: list[str], bars: DataFrame, least: int = 1) -> None:
    """Raises LeakageError unless every feature says that it is shifted by `least` bars and made of these bars. Reads no rows.

    What a column says was noted where its expression was built, and goes with it through joins, filters and files."""
    own = str(bars.semanticHash())
    for n in names:
        told = rows.schema[n].metadata
        if "shift" not in told:
            raise LeakageError(f"{n} does not say by how much it is shifted")
        if told["shift"] < least:
            raise LeakageError(f"{n} is shifted by {told['shift']} bars, not {least}")
        if told.get("made_of") != own:
            raise LeakageError(f"{n} is not made of these bars")


def check_feature_matrix(rows: DataFrame, names: list[str], bars: DataFrame, least: int = 1) -> None:
    """Raises LeakageError unless every feature says that it is shifted by `least` bars and made of these bars, and every row is one of them, once."""
    own = None
    for n in names:
        told = rows.schema[n].metadata
        if "shift" not in told:
            raise LeakageError(f"{n} does not say by how much it is shifted")
        if told["shift"] < least:
            raise LeakageError(f"{n} is shifted by {told['shift']} bars, not {least}")
        own = own or bars_hash(bars)
        if told.get("bars", own) != own:
            raise LeakageError(f"{n} is made of other bars")
    keys = ["instrument", "pos", "ts"]
    if rows.select(*keys).exceptAll(bars.select(*keys)).limit(1).count():
        raise LeakageError("rows are no bars, or occur twice")


def label_correlation(rows: Rel, names: list[str], target: str = "ret") -> Rel:
    """How many pairs each feature has with the label's return, and their correlation; one aggregation over all rows."""
    sums: dict[str, str] = {}
    for i, x in enumerate(names):
        a, b = f"CASE WHEN {target} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {target} END"
        sums |= {f"n{i}": f"count({a})", f"r{i}": f"covar_pop({x}, {target}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"}
    each = [{"feature": f"'{x}'", "n_pairs": f"n{i}", "correlation": f"r{i}"} for i, x in enumerate(names)]
    return rows.agg(["instrument"], **sums).melted(["instrument"], each).where("n_pairs > 0")


def check_labels_in_features(rows: Rel, names: list[str], limit: float = 0.98, least: int = 50) -> None:
    bad = label_correlation(rows, names).where(f"n_pairs >= {least} AND abs(correlation) > {limit}").df.collect()
    if bad:
        raise LeakageError(f"features that know the label: {sorted({r['feature'] for r in bad})}")


def _spiked(bars: DataFrame, at: int, factor: float) -> DataFrame:
    names = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    return bars.withColumns({c: F.when(F.col("pos") >= at, F.col(c) * factor).otherwise(F.col(c)) for c in names})


def looks_ahead(bars: DataFrame, build: Callable[[DataFrame], DataFrame], at: int, factor: float = 8.0) -> int:
    """How many rows before a bar change when prices and volumes from that bar on are multiplied; 0 for what is causal."""
    plain, other = (build(b).where(F.col("pos") < at) for b in (bars, _spiked(bars, at, factor)))
    return plain.exceptAll(other).count()


def changed_before(bars: DataFrame, build: Callable[[DataFrame], DataFrame], at: int, factor: float = 8.0) -> DataFrame:
    """The same for every column of what is built over the bars, in one pass over all of it: feature and changed."""
    keys = ["instrument", "pos"]
    plain, other = (build(b).where(F.col("pos") < at) for b in (bars, _spiked(bars, at, factor)))
    names = [c for c in plain.columns if c not in (*keys, "ts")]
    both = plain.select(*keys, F.struct(*names).alias("a")).join(other.select(*keys, F.struct(*names).alias("b")), keys, "full")
    sums = both.agg(*(F.sum(F.when(F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), 0).otherwise(1)).alias(n) for n in names))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("changed")) for n in names))))


def trimmed(rows: Rel, names: list[str]) -> Rel:
    """Rows from the first on that has all features; later gaps stay."""
    full = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return rows.steps(lambda s: {"first_full": f"min(CASE WHEN {full} THEN pos END) OVER (PARTITION BY instrument)"}).where("pos >= first_full")
