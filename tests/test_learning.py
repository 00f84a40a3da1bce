"""Trees, nets and tuning against plain versions: sums over rows made by one process, numeric derivatives, random search."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidegauge.operators import models as md
from tidegauge.operators import nets, trees, tuning
from tidegauge.operators.folds import Fold


def table(spark, n=500, classes=2, seed=1):
    """Rows whose class depends on two of three features, in steps, so that bins hold one value each."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)) * 20) / 20
    y = ((x[:, 0] + x[:, 1] ** 2 + r.normal(size=n) * 0.3 > 0.7).astype(int) + (x[:, 0] > 1).astype(int) * (classes > 2)).clip(0, classes - 1)
    w = r.uniform(0.5, 2, n)
    rows = spark.createDataFrame([("A", i, *map(float, x[i]), int(y[i]), float(w[i])) for i in range(n)], "instrument string, pos long, a double, b double, c double, label int, weight double")
    return rows, x, y, w


def ready(rows):
    return rows.withColumn("features", array_to_vector(F.array("a", "b", "c"))).withColumn("row_id", F.xxhash64("instrument", "pos"))


def plain_boosting(x, y, w, how, classes):
    """Level by level over sorted values, with all rows in each tree; trees as nested tuples."""
    share = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    base = np.array([math.log(share[1] / share[0])]) if classes == 2 else np.log(share)
    margin = np.tile(base, (len(x), 1))
    out = []

    def score(g, h):
        return max(abs(g) - how.l1, 0) ** 2 / (h + how.l2) if h + how.l2 > 0 else 0.0

    def grow(rows, g, h, depth):
        best = (1e-12, None)
        for f in range(x.shape[1]) if depth < how.depth else ():
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(h[left].sum(), h[right].sum()) >= how.least_hessian and min(len(left), len(right)) >= how.least_rows:
                    gain = 0.5 * (score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum()))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
        if best[1] is None:
            return -how.rate * np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - how.l1, 0) / (h[rows].sum() + how.l2)
        f, cut, left, right = best[1]
        return f, cut, grow(left, g, h, depth + 1), grow(right, g, h, depth + 1)

    def value(t, row):
        return t if not isinstance(t, tuple) else value(t[2] if row[t[0]] <= t[1] else t[3], row)

    for _ in range(how.rounds):
        g, h = trees.gradients(margin, y, w, how.curvature)
        made = [grow(np.arange(len(x)), g[:, k], h[:, k], 0) for k in range(margin.shape[1])]
        margin = margin + np.array([[value(t, row) for t in made] for row in x])
        out.append(made)
    return margin, out


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_is_the_plain_one(spark, classes):
    rows, x, y, w = table(spark, 500, classes)
    how = trees.Boost(rounds=3, rate=0.3, depth=3, l1=0.1, l2=1.5, least_hessian=2.0, least_rows=5)
    got = trees.boosted(ready(rows), F.col("label"), classes, how, 7)
    want, made = plain_boosting(x, y, w, how, classes)
    assert np.allclose(got.margins(x), want, atol=1e-9)
    assert len(got.trees) == 3 * len(made[0]) and all(t.feature[0] == m[0] and t.cut[0] == m[1] for t, m in zip(got.trees, sum(made, []), strict=True))
    assert np.allclose(got.probabilities(x).sum(axis=1), 1)


def test_gains_are_those_of_sorted_rows():
    r = np.random.default_rng(3)
    how = trees.Boost(l1=0.2, l2=0.7, least_hessian=0.5, least_rows=4)
    bins, g, h = r.integers(0, 30, 500), r.normal(size=500), r.uniform(0.01, 0.3, 500)
    sums = np.stack([np.bincount(bins, v, 30) for v in (g, h, np.ones(500))], axis=1)[None]
    for b, gain in enumerate(how.gains(sums)[0]):
        left = bins <= b
        if min(h[left].sum(), h[~left].sum()) < 0.5 or min(left.sum(), (~left).sum()) < 4:
            assert gain == -np.inf
            continue
        t = [max(abs(s.sum()) - 0.2, 0) ** 2 for s in (g[left], g[~left], g)]
        assert gain == pytest.approx(0.5 * (t[0] / (h[left].sum() + 0.7) + t[1] / (h[~left].sum() + 0.7) - t[2] / (h.sum() + 0.7)))


@pytest.mark.parametrize("k", [1, 3])
def test_gradients_are_derivatives(k):
    r = np.random.default_rng(0)
    m, y, w, e = r.normal(size=(6, k)), r.integers(0, max(2, k), 6), r.uniform(0.5, 2, 6), 1e-5

    def loss(m):
        return -w * np.log(trees.probabilities(m)[np.arange(6), y])

    g, h = trees.gradients(m, y, w, 1.0)
    for j in range(k):
        d = np.eye(k)[j] * e
        assert np.allclose(g[:, j], (loss(m + d) - loss(m - d)) / (2 * e), atol=1e-8)
        assert np.allclose(h[:, j], (loss(m + d) - 2 * loss(m) + loss(m - d)) / e**2, atol=1e-4)


def test_leaves_are_met_best_first(spark):
    """On a lopsided table trees have exactly as many leaves as asked, one branch much deeper; more leaves only add splits."""
    n = 600
    x = np.arange(n) / n
    step = np.floor(np.log2(np.arange(n) + 1))
    rows = spark.createDataFrame([("A", i, float(x[i]), 0.0, 0.0, int(step[i] % 2), 1.0) for i in range(n)], "instrument string, pos long, a double, b double, c double, label int, weight double")
    sizes, gains = [], []
    for leaves in (2, 4, 7):
        how = trees.Boost(rounds=1, rate=1.0, depth=-1, leaves=leaves, l2=0.0, least_hessian=1e-3, least_rows=3, bins=1000)
        t = trees.boosted(ready(rows), F.col("label"), 2, how, 1).trees[0]
        sizes.append(int((t.left < 0).sum()))
        gains.append(set(t.cut[t.left >= 0]))
    assert sizes == [2, 4, 7] and gains[0] < gains[1] < gains[2]
    depth, todo = 0, [(0, 0)]
    while todo:
        node, d = todo.pop()
        depth = max(depth, d)
        todo += [(c, d + 1) for c in (t.left[node], t.right[node]) if c >= 0]
    assert depth > math.ceil(math.log2(7))


def plain_scattered(x, y, w, how, seed, tree, classes):
    """One extremely random tree by recursion, with the same draws."""

    def grow(rows, node, depth):
        weights = np.bincount(y[rows], w[rows], classes)
        best = (1e-12, None)
        if depth < how.depth and len(rows) >= 2 * how.least_rows and np.count_nonzero(weights) > 1:
            for f, cut in trees.tried(seed, tree, node, x[rows].min(axis=0), x[rows].max(axis=0), how.features):
                left = rows[x[rows, f] <= cut]
                if min(len(left), len(rows) - len(left)) >= how.least_rows:
                    gini = [v.sum() - (v**2).sum() / v.sum() for v in (weights, np.bincount(y[left], w[left], classes), weights - np.bincount(y[left], w[left], classes))]
                    if gini[0] - gini[1] - gini[2] > best[0]:
                        best = (gini[0] - gini[1] - gini[2], (f, cut, left))
        if best[1] is None:
            return weights / weights.sum()
        f, cut, left = best[1]
        return f, cut, grow(left, 2 * node, depth + 1), grow(np.setdiff1d(rows, left), 2 * node + 1, depth + 1)

    return grow(np.arange(len(x)), 1, 0)


def test_random_trees_are_the_plain_ones(spark):
    rows, x, y, w = table(spark, 400, 3)
    how = trees.Random(5, 4, 10, 2, together=3)
    got = trees.scattered(ready(rows), F.col("label"), 3, how, 11)

    def value(t, row):
        return t if not isinstance(t, tuple) else value(t[2] if row[t[0]] <= t[1] else t[3], row)

    plain = [plain_scattered(x, y, w, how, 11, t, 3) for t in range(5)]
    assert np.allclose(got.probabilities(x), np.mean([[value(t, row) for row in x] for t in plain], axis=0), atol=1e-9)


def test_cuts_are_uniform():
    low, high = np.array([0.0, -2.0, 5.0]), np.array([1.0, 6.0, 5.0])
    made = [c for node in range(1, 3000) for c in trees.tried(5, 0, node, low, high, 2)]
    for f in (0, 1):
        u = np.sort([(c - low[f]) / (high[f] - low[f]) for g, c in made if g == f])
        assert np.abs(u - (np.arange(len(u)) + 0.5) / len(u)).max() < 1.63 / math.sqrt(len(u))
    assert {g for g, _ in made} == {0, 1}


# nets


SHAPES = [nets.Shape("lstm", 4, 3, 3, 5, 2, both_ways=True), nets.Shape("gru", 4, 3, 3, 5), nets.Shape("transformer", 4, 3, 3, 8, 2, heads=2), nets.Shape("transformer", 4, 3, 3, 8, 1, heads=4, causal=False)]


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: f"{s.kind}{s.layers}")
def test_gradients_of_nets(shape):
    r = np.random.default_rng(2)
    p = nets.started(shape, 1)
    x, y, w = r.normal(size=(7, 12)), r.integers(0, 3, 7), r.uniform(0.5, 2, 7)
    v, sizes = nets.flat(p), {k: a.shape for k, a in p.items()}

    def loss(v, drop=None):
        return nets.losses(shape, nets.unflat(sizes, v), x, y, w, np.random.default_rng(9) if drop else None)[-2]

    for drop in (False, True):
        g = nets.losses(shape, p, x, y, w, np.random.default_rng(9) if drop else None)[:-2]
        at = r.choice(len(v), 60, replace=False)
        for i in at:
            d = np.zeros(len(v))
            d[i] = 1e-5
            assert g[i] == pytest.approx((loss(v + d, drop) - loss(v - d, drop)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: f"{s.kind}{s.layers}")
def test_order_of_bars_matters(shape):
    p = {k: nets.Value(v) for k, v in nets.started(shape, 1).items()}
    x = np.random.default_rng(0).normal(size=(2, 4, 3))
    assert not np.allclose(nets.run(shape, p, x).array, nets.run(shape, p, x[:, [1, 0, 2, 3]]).array)


def test_causal_tokens_do_not_look_ahead():
    shape = nets.Shape("transformer", 4, 3, 2, 8, 2, heads=2)
    p = {k: nets.Value(v) for k, v in nets.started(shape, 1).items()}
    linear = lambda name, v: v @ p[f"{name}.w"] + p[f"{name}.b"]
    norm = lambda name, v: v.normed() * p[f"{name}.w"] + p[f"{name}.b"]
    x = np.random.default_rng(0).normal(size=(1, 4, 3))
    other = x.copy()
    other[:, 3] += 1
    seen = []
    for data in (x, other):
        short = nets.Shape("transformer", 3, 3, 2, 8, 2, heads=2)
        cut = p | {"pos": p["pos"][:3]}
        seen.append(nets._attended(short, cut, data[:, :3], linear, norm, lambda v: v).array)
    assert np.allclose(*seen)


@pytest.mark.parametrize("kind", ["lstm", "gru", "transformer"])
def test_nets_learn_from_bars_before(spark, kind):
    """The label is the sign of the value two bars before, which only a window shows; a test row sees bars of the training rows."""
    r = np.random.default_rng(4)
    v = r.normal(size=500)
    rows = spark.createDataFrame([("A", i, i, float(v[i]), 1 if i > 1 and v[i - 2] > 0 else -1, i) for i in range(500)], "instrument string, ts long, pos long, v double, label int, t1_pos long")
    size = {"d_model": 16, "n_heads": 2, "n_layers": 1} if kind == "transformer" else {"hidden_size": 16}
    epochs: list[dict] = []
    walk = md.walk_forward(rows, ["v"], [Fold(0, 0, 400, 400, 500)], lambda: md.family(kind, {"seq_len": 4, "epochs": 30, "lr": 0.02, "dropout": 0.0, "patience": 30, **size}), progress=lambda what, told: epochs.append(told) if what == "epoch" else None)
    got = walk.oos.toPandas()
    assert len(got) == 100 and (got["y_pred"] == got["y_true"]).mean() > 0.9
    assert [e["epoch"] for e in epochs] == list(range(1, 31)) and walk.models[0].fitted[0].history == epochs


def test_early_stop(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([("A", i, float(r.normal()), int(r.integers(0, 2)) * 2 - 1) for i in range(200)], "instrument string, pos long, v double, label int")
    net = md.family("gru", {"seq_len": 3, "epochs": 60, "lr": 0.05, "patience": 2, "hidden_size": 8}).fit(rows, ["v"]).fitted[0]
    losses = [h["val_loss"] for h in net.history]
    assert len(losses) < 60 and int(np.argmin(losses)) == len(losses) - 3


# tuning


def test_parzen_beats_random_draws():
    space = {"x": tuning.Range(1e-4, 1.0, log=True), "n": tuning.Range(1, 20, whole=True), "kind": ["a", "b", "c"]}

    def cost(t):
        return (math.log10(t["x"]) + 2) ** 2 + ((t["n"] - 12) / 5) ** 2 + (t["kind"] != "b")

    best = {False: [], True: []}
    for seed in range(12):
        for plain in (False, True):
            p = tuning.Parzen(space, seed, random=10**9 if plain else 10)
            for _ in range(60):
                t = p.ask()
                assert 1e-4 <= t["x"] <= 1 and 1 <= t["n"] <= 20 and isinstance(t["n"], int) and t["kind"] in "abc"
                p.tell(t, cost(t))
            best[plain].append(min(c for c, _ in p.trials))
    assert np.mean(best[False]) < np.mean(best[True]) and np.median(best[False]) < 0.5 * np.median(best[True])


def test_given_settings_are_the_first_trial(spark):
    rows, *_ = table(spark, 300)
    told = []
    got = md.tuned(lambda p: md.family("logreg", p), md.Logistic.search, {"C": 0.5, "max_iter": 20}, rows, ["a", "b", "c"], 4, 5, 1, lambda what, t: told.append(t))
    assert told[0]["params"] == {"C": 0.5} and len(told) == 4 and got["max_iter"] == 20
    least = min(told, key=lambda t: t["loss"])
    assert got == {"C": 0.5, "max_iter": 20} | least["params"] and least["loss"] <= told[0]["loss"]


# permutation importance


def test_importance_is_one_plan(spark):
    rows, *_ = table(spark, 400)
    rows = rows.withColumn("label", F.when(F.col("label") > 0, 1).otherwise(-1)).withColumn("ts", F.col("pos")).withColumn("t1_pos", F.col("pos")).cache()
    walk = md.walk_forward(rows, ["a", "b", "c"], [Fold(0, 0, 200, 200, 300), Fold(1, 100, 300, 300, 400)], lambda: md.family("random_forest", {"n_estimators": 5}))
    mixed = md.shuffled(rows, ["a", "b", "c"], walk.folds).toPandas()
    assert len(mixed) == 200 * 4
    plain = mixed[mixed["feature"] == ""].set_index(["fold_id", "pos"])
    for n in ("a", "b", "c"):
        own = mixed[mixed["feature"] == n].set_index(["fold_id", "pos"]).loc[plain.index]
        assert all((own[m] == plain[m]).all() for m in ("a", "b", "c") if m != n) and (own[n] != plain[n]).mean() > 0.8
        assert all(np.allclose(np.sort(own[n].loc[f]), np.sort(plain[n].loc[f])) for f in (0, 1))
    sc, jobs = spark.sparkContext, []
    for names in (["a"], ["a", "b", "c"]):
        sc.setJobGroup(f"importance of {len(names)}", "")
        got = {r["feature"]: r["importance"] for r in md.permutation_importance(walk, rows, names).collect()} if len(names) == 3 else md.permutation_importance(md.replace(walk, folds=walk.folds[:1]), rows, names).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"importance of {len(names)}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # adaptive execution submits a job for each exchange; more folds and features bring none
    assert jobs[0] == jobs[1] and got["a"] > got["c"] and set(got) == {"a", "b", "c"}


def test_margins_are_checkpointed(spark, monkeypatch):
    """Rounds after a checkpoint go on from its margins."""
    rows, x, y, w = table(spark, 200)
    how = trees.Boost(rounds=6, rate=0.3, depth=1, least_hessian=1.0)
    plain = trees.boosted(ready(rows), F.col("label"), 2, how, 7).margins(x)
    monkeypatch.setattr(trees, "CHECKPOINT", 2)
    assert np.allclose(trees.boosted(ready(rows), F.col("label"), 2, how, 7).margins(x), plain)
