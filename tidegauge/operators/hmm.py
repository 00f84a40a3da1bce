"""A hidden Markov model of two Gaussian states, fitted again and again as a series goes on.

A series is cut into blocks of BLOCK bars. Fits start anew each time, so that they do not wait for each other: one whose
past lies within a block is a task; a longer one is made by all of its blocks together. There a block's effect on the
states' probabilities is one 2 x 2 matrix for each fit; their products along the blocks give what enters each block from
both sides, blocks then sum what they expect, and the sums are the next model. A row is a block with FITS fits at most;
the driver learns only how many fits go on. Bars are then scored by blocks with the LOOK_BACK bars before them, all bars
of a block at once.

Cases: a null close, or one that is not positive, has no return: fits pass over it, and bars that look back on it are
null. A fit that fails (no spread, a state without weight, or too few returns) leaves the model before it in place until
the next; bars before the first model are null. Bars are counted in the order of `pos`, which may have holes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.shared import shared_dir

LOOK_BACK = 250
BLOCK = 4096
FITS = 256
#: A model as an array: start 0:2, moves 2:6, means 6:8, variances 8:10.
SIZE = 10


def _passes(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of the states, expected moves between them, and the log-likelihood."""
    log = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    top = log.max(axis=1, keepdims=True)
    p = np.exp(log - top)
    n = len(x)
    a, scale, b = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    for t in range(n):
        a[t] = (start if t == 0 else a[t - 1] @ move) * p[t]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = move @ (p[t + 1] * b[t + 1]) / scale[t + 1]
    post = a * b
    moves = (a[:-1, :, None] * move * (p[1:] * b[1:] / scale[1:, None])[:, None, :]).sum(axis=0)
    return post / post.sum(axis=1, keepdims=True), moves, float((np.log(scale) + top[:, 0]).sum())


def fit(x: np.ndarray, n_iter: int) -> tuple | None:
    """Start, transitions, means and variances by expectation maximisation from a calm and a wild state; None if it fails."""
    spread = x.var()
    if not spread > 0:
        return None
    start, move = np.full(2, 0.5), np.array([[0.95, 0.05], [0.05, 0.95]])
    mean, var, before = np.full(2, x.mean()), np.array([0.5, 2.0]) * spread, -np.inf
    for _ in range(n_iter):
        post, moves, like = _passes(x, start, move, mean, var)
        weight = post.sum(axis=0)
        if not np.isfinite(like) or weight.min() < 1e-6:
            return None
        start, move = post[0], (moves + 1e-9) / (moves + 1e-9).sum(axis=1, keepdims=True)
        mean = (post * x[:, None]).sum(axis=0) / weight
        var = (post * (x[:, None] - mean) ** 2).sum(axis=0) / weight + 1e-12
        if abs(like - before) < 1e-2:
            break
        before = like
    return start, move, mean, var


def _laid_out(model: tuple) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in model])


def _parts(models: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return models[:, :2], models[:, 2:6].reshape(-1, 2, 2), models[:, 6:8], models[:, 8:10]


def _likelihoods(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value for each model and state, relative to the likelier state; and the logarithm of that one."""
    log = -0.5 * (np.log(2 * np.pi * var) + (x[..., None] - mean) ** 2 / var)
    top = log.max(axis=-1)
    return np.exp(log - top[..., None]), top


def scored(r: np.ndarray, at: np.ndarray, models: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Probability of the more volatile state at places `at` of r, each by its own model and the `depth` returns up to it."""
    start, move, mean, var = _parts(models)
    state, broken = start, np.zeros(len(at), bool)
    for back in range(int(depth.max(initial=0)) - 1, -1, -1):
        x = r[np.maximum(at - back, 0)]
        on = back < depth
        p, _ = _likelihoods(np.nan_to_num(x), mean, var)
        ahead = np.where((back == depth - 1)[:, None], start, np.einsum("ki,kij->kj", state, move)) * p
        state = np.where(on[:, None], ahead / ahead.sum(axis=1, keepdims=True), state)
        broken |= on & ~np.isfinite(x)
    told = state[np.arange(len(at)), var.argmax(axis=1)] if len(at) else np.zeros(0)
    return np.where(broken | (depth < 1), np.nan, told)


def transfer(x: np.ndarray, begin: int, first: np.ndarray, end: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each model what a block does to a row of probabilities, as a matrix that sums to 1 and the logarithm of its size.

    Only bars before `end` count; the `first` one of a series has no move before it."""
    _, move, mean, var = _parts(models)
    p, top = _likelihoods(x[:, None], mean, var)
    made, size = np.broadcast_to(np.eye(2), (len(models), 2, 2)).copy(), np.zeros(len(models))
    for i in np.flatnonzero(np.isfinite(x)):
        on = begin + i < end
        ahead = np.where((begin + i == first)[:, None, None], made, made @ move) * p[i][:, None, :]
        total = ahead.sum(axis=(1, 2))
        made = np.where(on[:, None, None], ahead / total[:, None, None], made)
        size += np.where(on, np.log(total) + top[i], 0)
    return made, size


def expected(x: np.ndarray, begin: int, first: np.ndarray, end: np.ndarray, models: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each model, with what enters its block from the left and the right: weight of the states, first and second moments about the means, moves, and the posterior of the first bar."""
    _, move, mean, var = _parts(models)
    p, _ = _likelihoods(x[:, None], mean, var)
    some, state, states, out = np.flatnonzero(np.isfinite(x)), left, {}, np.zeros((len(models), 12))
    for i in some:
        ahead = np.where((begin + i == first)[:, None], state, np.einsum("ki,kij->kj", state, move)) * p[i]
        states[i] = state, np.where((begin + i < end)[:, None], ahead / ahead.sum(axis=1, keepdims=True), state)
        state = states[i][1]
    for i in some[::-1]:
        on, opening = (begin + i < end)[:, None], (begin + i == first)[:, None]
        before, here = states[i]
        post = here * right
        post = post / post.sum(axis=1, keepdims=True)
        away = x[i] - mean
        out[:, :6] += np.where(on, np.hstack([post, post * away, post * away**2]), 0)
        onward = p[i] * right
        moves = before[:, :, None] * move * onward[:, None, :]
        out[:, 6:10] += np.where(on & ~opening, (moves / moves.sum(axis=(1, 2), keepdims=True)).reshape(-1, 4), 0)
        out[:, 10:] += np.where(on & opening, post, 0)
        back = np.einsum("kij,kj->ki", move, onward)
        right = np.where(on, back / back.sum(axis=1, keepdims=True), right)
    return out


def _through_blocks(blocks: DataFrame, fits: DataFrame, values: list[str], work, n_out: int, block: int) -> DataFrame:
    """instrument, t, block and `made`: what work(x, begin, first, end, values) makes of each fit in each block that the rows of `fits` (instrument, fit, t, first, block) name."""
    packed = fits.select("instrument", "block", (F.col("fit") / FITS).cast("long").alias("part"), F.concat(F.array(F.col("t").cast("double"), F.col("first").cast("double")), *values).alias("v"))
    packed = packed.groupBy("instrument", "block", "part").agg(F.collect_list("v").alias("fits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for instrument, number, x, each in zip(pdf["instrument"], pdf["block"], pdf["r"], pdf["fits"], strict=True):
                v = np.stack([np.asarray(e, float) for e in each])
                made = work(np.asarray(x, float), number * block, v[:, 1], v[:, 0], v[:, 2:])
                yield pd.DataFrame({"instrument": instrument, "t": v[:, 0].astype(int), "block": number, "made": list(made.reshape(len(v), n_out))})

    return packed.join(blocks, ["instrument", "block"]).select("instrument", "block", "r", "fits").mapInPandas(run, "instrument string, t long, block long, made array<double>")


def _along(pdf: pd.DataFrame) -> pd.DataFrame:
    """What enters each block of one fit from the left and the right, and the log-likelihood of all; a row for each block."""
    pdf = pdf.sort_values("block")
    made = np.stack(pdf["made"].to_numpy())
    matrix, start = made[:, :4].reshape(-1, 2, 2), np.asarray(pdf["model"].iloc[0], float)[:2]
    n, like = len(pdf), made[:, 4].sum()
    left, right = np.empty((n, 2)), np.ones((n, 2))
    left[0] = start
    for i in range(n):
        ahead = left[i] @ matrix[i]
        like += np.log(ahead.sum())
        if i + 1 < n:
            left[i + 1] = ahead / ahead.sum()
    for i in range(n - 1, 0, -1):
        back = matrix[i] @ right[i]
        right[i - 1] = back / back.sum()
    return pdf[["instrument", "t", "block"]].assign(ends=list(np.hstack([left, right])), like=like)


def _next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The next model of each fit from the sums over its blocks; a state of "failed", "done" or "on"."""
    for pdf in batches:
        models, states = [], []
        for model, sums, like, before in zip(pdf["model"], pdf["sums"], pdf["like"], pdf["before"], strict=True):
            model, sums = np.asarray(model, float), np.asarray(sums, float)
            weight = sums[:2]
            if not np.isfinite(like) or weight.min() < 1e-6:
                models.append(model)
                states.append("failed")
                continue
            shift, moves = sums[2:4] / weight, sums[6:10].reshape(2, 2) + 1e-9
            var = np.maximum(sums[4:6] / weight - shift**2, 0) + 1e-12
            models.append(_laid_out((sums[10:], moves / moves.sum(axis=1, keepdims=True), model[6:8] + shift, var)))
            states.append("done" if abs(like - before) < 1e-2 else "on")
        yield pdf[["instrument", "fit", "t", "first"]].assign(model=models, before=pdf["like"], state=states)


MODELS = "instrument string, fit long, t long, first long, model array<double>, before double, state string"


def _long_fits(blocks: DataFrame, fits: DataFrame, n_iter: int, min_train: int, block: int) -> DataFrame:
    """instrument, t, model of fits (instrument, fit, t, first) over several blocks each, all of them side by side."""
    span = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("t") - 1) / block).cast("long"))).alias("block")

    def moments(x, begin, first, end, v):
        use = np.isfinite(x) & (begin + np.arange(len(x)) < end[:, None])
        return np.stack([use.sum(axis=1), np.where(use, x, 0).sum(axis=1), np.where(use, x * x, 0).sum(axis=1)], axis=1)

    seen = _through_blocks(blocks, fits.select("*", span), [], moments, 3, block).groupBy("instrument", "t").agg(*(F.sum(F.col("made")[i]).alias(c) for i, c in enumerate("nab")))
    spread = F.col("b") / F.col("n") - (F.col("a") / F.col("n")) ** 2
    first = F.array(*map(F.lit, (0.5, 0.5, 0.95, 0.05, 0.05, 0.95)), F.col("a") / F.col("n"), F.col("a") / F.col("n"), 0.5 * spread, 2.0 * spread)
    models = fits.join(seen, ["instrument", "t"]).where((F.col("n") >= min_train // 2) & (spread > 0))
    models = models.select("instrument", "fit", "t", "first", first.alias("model"), F.lit(float("-inf")).alias("before"), F.lit("on").alias("state")).checkpoint()

    def matrices(x, begin, first, end, v):
        made, size = transfer(x, begin, first, end, v)
        return np.hstack([made.reshape(-1, 4), size[:, None]])

    def sums(x, begin, first, end, v):
        return expected(x, begin, first, end, v[:, :SIZE], v[:, SIZE : SIZE + 2], v[:, SIZE + 2 :])

    for _ in range(n_iter):
        going = models.where("state = 'on'")
        if going.isEmpty():
            break
        made = _through_blocks(blocks, going.select("*", span), ["model"], matrices, 5, block).join(going.select("instrument", "t", "model"), ["instrument", "t"])
        ends = made.groupBy("instrument", "t").applyInPandas(_along, "instrument string, t long, block long, ends array<double>, like double").checkpoint()
        told = _through_blocks(blocks, going.join(ends, ["instrument", "t"]), ["model", "ends"], sums, 12, block)
        told = told.groupBy("instrument", "t").agg(F.array(*(F.sum(F.col("made")[i]) for i in range(12))).alias("sums"))
        likes = ends.where("block = 0").select("instrument", "t", "like")
        ahead = going.join(told, ["instrument", "t"]).join(likes, ["instrument", "t"]).mapInPandas(_next, MODELS)
        models = models.where("state <> 'on'").unionByName(ahead).repartition("instrument", "fit").checkpoint()  # else partitions add up
    return models.where("state <> 'failed'").select("instrument", "t", "model")


def hmm_state(bars: DataFrame, refit: int = 60, min_train: int = 250, n_iter: int = 50, block: int = BLOCK) -> DataFrame:
    """instrument, ts, pos and hmm_state: the probability of the more volatile state, from a bar and those before it only.

    Every `refit` bars from `min_train` on a model is fitted to all returns before; a bar is scored by the last one that was made."""
    shared_dir(bars.sparkSession)
    along = Window.partitionBy("instrument").orderBy("pos")
    close = F.when(F.col("close") > 0, F.col("close").cast("double"))
    rows = bars.select("instrument", "ts", "pos", (F.row_number().over(along) - 1).cast("long").alias("t"), (F.log(close) - F.log(F.lag(close).over(along))).alias("r")).checkpoint()
    inside = (F.col("t") / block).cast("long")
    blocks = rows.groupBy("instrument", inside.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda e: F.coalesce(e["r"], F.lit(float("nan")))).alias("r")).checkpoint()
    facts = rows.groupBy("instrument").agg(F.count("*").alias("n"), F.min(F.when(F.col("r").isNotNull(), F.col("t"))).alias("first"))
    times = F.posexplode(F.sequence(F.lit(min_train).cast("long"), F.col("n") - 1, F.lit(refit).cast("long"))).alias("fit", "t")
    fits = facts.where((F.col("n") > min_train) & F.col("first").isNotNull()).select("instrument", times, "first").withColumn("fit", F.col("fit").cast("long")).checkpoint()

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for t, x in zip(pdf["t"], pdf["r"], strict=True):
                train = np.asarray(x, float)[1:t]
                train = train[np.isfinite(train)]
                found = fit(train, n_iter) if len(train) >= max(1, min_train // 2) else None
                made.append(None if found is None else _laid_out(found))
            yield pdf[["instrument", "t"]].assign(model=made)

    short = fits.where(F.col("t") <= block).repartition("instrument", "fit").join(blocks.where("block = 0").select("instrument", "r"), "instrument")
    models = short.select("instrument", "t", "r").mapInPandas(alone, "instrument string, t long, model array<double>").where("model is not null")
    long = fits.where(F.col("t") > block)
    if not long.isEmpty():
        models = models.unionByName(_long_fits(blocks, long, n_iter, min_train, block))
    until = F.coalesce(F.lead("t").over(Window.partitionBy("instrument").orderBy("t")), F.col("n"))
    models = models.join(facts.select("instrument", "n"), "instrument").withColumn("until", until)
    serving = models.select("instrument", "t", "model", F.explode(F.sequence((F.col("t") / block).cast("long"), ((F.col("until") - 1) / block).cast("long"))).alias("block"))
    near = rows.select("*", F.explode(F.sequence(inside, ((F.col("t") + LOOK_BACK) / block).cast("long"))).alias("block"))

    def score(key: tuple, pdf: pd.DataFrame, served: pd.DataFrame) -> pd.DataFrame:
        pdf, served = pdf.sort_values("t"), served.sort_values("t")
        t, r = pdf["t"].to_numpy(), pdf["r"].to_numpy(float)
        own, out = t // block == key[1], np.full(len(t), np.nan)
        at = np.searchsorted(served["t"].to_numpy(), t, side="right") - 1
        use = np.flatnonzero(own & (at >= 0))
        if use.size:
            models = np.stack([np.asarray(m, float) for m in served["model"]])[at[use]]
            out[use] = scored(r, use, models, np.minimum(t[use], LOOK_BACK + 1))
        return pdf.assign(hmm_state=out)[["instrument", "ts", "pos", "hmm_state"]][own]

    scores = near.groupBy("instrument", "block").cogroup(serving.groupBy("instrument", "block")).applyInPandas(score, "instrument string, ts timestamp_ntz, pos long, hmm_state double")
    return scores.withColumn("hmm_state", F.nanvl("hmm_state", F.lit(None).cast("double")))
