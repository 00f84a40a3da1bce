"""Bars and causal features of a stream of trades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def bars(trades: DataFrame, instrument: Column, ts: Column, price: Column, order: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of closed windows; trades later than the watermark are left out, and a bar is final once it is given."""
    t = trades.select(instrument.alias("instrument"), ts.cast("timestamp").alias("t"), price.alias("p"), order.alias("o"))
    made = t.withWatermark("t", late).groupBy("instrument", F.window("t", width)).agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("*").cast("double").alias("volume"))
    return made.select("instrument", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def ema(bars_: DataFrame, alpha: float, column: str = "close") -> DataFrame:
    """instrument, ts and the exponential average of a column; one number of state for each instrument."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("ts")
            out = []
            for x in pdf[column]:
                y = x if y is None else (1 - alpha) * y + alpha * x
                out.append(y)
            if out:
                state.update((float(y),))
            yield pd.DataFrame({"instrument": pdf["instrument"], "ts": pdf["ts"], "ema": out})

    return bars_.groupBy("instrument").applyInPandasWithState(run, "instrument string, ts timestamp, ema double", "y double", "append", GroupStateTimeout.NoTimeout)
