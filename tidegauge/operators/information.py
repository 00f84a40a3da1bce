"""Mutual information of continuous features with a discrete label, by nearest neighbours.

For a value the distance to its k-th neighbour with the same label is set against how many values of any label lie
nearer than that. Values of each feature are range-sorted, so that its neighbours lie in the same range, or in the
first and last values of the ranges beside it, which are few and are handed on as halos. How many values lie within a
distance is the difference of two ranks; a rank is looked up in the range where it falls, on top of the sizes of the
ranges before. Equal values of one label are one row with a count, so that ties make no range large.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.shared import shared_dir

#: Different values of a range.
RANGE = 65_536
PART = ["feature", "part"]


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: the series for large ones, eight steps up."""
    m = n + 8
    steps = sum((1 / (n + j) for j in range(8)), F.lit(0.0))
    return F.ln(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) - steps


def _halos(k: int):
    """Of one feature and label the last values before each range, and the first behind it."""

    def run(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("x")
        x, n, part = (ends[c].to_numpy() for c in ("x", "n", "part"))
        out = []
        for p in np.unique(part):
            for side, own in (("before", np.flatnonzero(part < p)[-k - 1 :]), ("after", np.flatnonzero(part > p)[: k + 1])):
                out += [(ends["feature"].iloc[0], ends["y"].iloc[0], p, x[i], n[i]) for i in own]
        return pd.DataFrame(out, columns=["feature", "y", "part", "x", "n"])

    return run


def _radii(k: int):
    """For the values of one range and label the distance to the k-th neighbour (to the last, if there are fewer)."""

    def run(own: pd.DataFrame, halo: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({c: [] for c in ("feature", "y", "x", "n", "r", "k")}).astype({"feature": str, "y": "int64", "n": "int64", "k": "int64"})
        own = own.sort_values("x")
        both = pd.concat([own[["x", "n"]], halo[["x", "n"]]]).sort_values("x")
        near = min(k, int(own["total"].iloc[0]) - 1)
        copies = np.minimum(both["n"].to_numpy(), near + 1)
        values = np.repeat(both["x"].to_numpy(), copies)
        x = own["x"].to_numpy()
        first = np.searchsorted(values, x)
        r = np.full(len(x), np.inf)
        for j in range(near + 1):  # j of the neighbours below, the others above
            low, high = first - j, first - j + near
            ok = (low >= 0) & (high < len(values))
            r[ok] = np.minimum(r[ok], np.maximum(x[ok] - values[low[ok]], values[high[ok]] - x[ok]))
        return pd.DataFrame({"feature": own["feature"], "y": own["y"], "x": x, "n": own["n"], "r": r, "k": near})

    return run


def _ranks(offsets: dict[tuple[str, int], int]):
    """For each probe of a range how many values lie below what it asks for: less than r below x, or less than r above it."""

    def run(probes: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        names = ["feature", "x", "y", "n", "k", "rank"]
        if probes.empty:
            return pd.DataFrame({c: [] for c in names}).astype({"feature": str, "y": "int64", "n": "int64", "k": "int64", "rank": "int64"})
        values = values.sort_values("x")
        v, upto = values["x"].to_numpy(), np.r_[0, np.cumsum(values["n"].to_numpy())]
        x, r, side = (probes[c].to_numpy() for c in ("x", "r", "side"))

        def beyond(i: np.ndarray) -> np.ndarray:
            """Whether the value at i lies behind the bound of its probe."""
            d = v[np.minimum(i, len(v) - 1)] - x
            return np.where(side > 0, np.where(r > 0, d >= r, d > 0), np.where(r > 0, -d < r, d >= 0))

        at = np.searchsorted(v, x + side * r)
        while (back := (at > 0) & beyond(np.maximum(at - 1, 0))).any():
            at = at - back
        while (on := (at < len(v)) & ~beyond(at)).any():
            at = at + on
        part = int(probes["part"].iloc[0])
        rank = offsets.get((probes["feature"].iloc[0], part), 0) + upto[at]
        return probes.assign(rank=rank * side)[names]

    return run


def nearest(rows: DataFrame, names: list[str], label: str = "label", neighbours: int = 3, size: int = RANGE) -> DataFrame:
    """feature and information (in nats, never below 0), over rows that have a label and all features.

    Labels that occur once are left out, as nothing is near to them."""
    shared_dir(rows.sparkSession)
    full = rows.dropna(subset=[*names, label])
    long = full.select(F.col(label).cast("long").alias("y"), F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names))))
    values = long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    totals = values.groupBy("feature", "y").agg(F.sum("n").alias("total")).where("total > 1")
    values = values.join(totals, ["feature", "y"])
    parts = max(1, math.ceil(values.count() / size))
    values = values.repartitionByRange(parts, "feature", "x").withColumn("part", F.spark_partition_id()).checkpoint()

    w = Window.partitionBy("feature", "y", "part")
    ends = values.withColumn("up", F.row_number().over(w.orderBy("x"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("x")))).where(f"up <= {neighbours + 1} or down <= {neighbours + 1}")
    halos = ends.select("feature", "y", "part", "x", "n").groupBy("feature", "y").applyInPandas(_halos(neighbours), "feature string, y long, part int, x double, n long")
    by = ["feature", "y", "part"]
    radii = values.groupBy(*by).cogroup(halos.groupBy(*by)).applyInPandas(_radii(neighbours), "feature string, y long, x double, n long, r double, k long").checkpoint()

    # one row for each range of a feature; there are about as many as ranges
    edges: dict[str, list] = {}
    offsets: dict[tuple[str, int], int] = {}
    for e in values.groupBy(*PART).agg(F.min("x").alias("low"), F.sum("n").alias("n")).orderBy(*PART).collect():
        own = edges.setdefault(e["feature"], [])
        offsets[e["feature"], e["part"]] = own[-1][2] if own else 0
        own.append((e["low"], e["part"], (own[-1][2] if own else 0) + e["n"]))

    @F.pandas_udf("int")
    def part_of(feature: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for name in feature.unique():
            low, part = (np.array(c) for c in list(zip(*edges[name], strict=True))[:2])
            mine = (feature == name).to_numpy()
            out[mine] = part[np.maximum(np.searchsorted(low, x[mine], side="right") - 1, 0)]
        return pd.Series(out)

    probes = radii.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("part", part_of("feature", F.col("x") + F.col("side") * F.col("r")))
    ranks = probes.groupBy(*PART).cogroup(values.groupBy(*PART)).applyInPandas(_ranks(offsets), "feature string, x double, y long, n long, k long, rank long")
    near = ranks.groupBy("feature", "x", "y", "n", "k").agg(F.sum("rank").alias("m"))
    sums = near.join(totals, ["feature", "y"]).groupBy("feature").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("total")) - digamma(F.col("m")))).alias("s"))
    return sums.select("feature", F.greatest(F.lit(0.0), digamma(F.col("all")) + F.col("s") / F.col("all")).alias("information"))
