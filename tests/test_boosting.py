"""Tree settings, fits inside folds, calibration and stacking."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import boosting as B
from strata.operators import validate as V
from strata.operators.features import V5_22, FeaturePlan
from strata.operators.folds import kfold_stratified
from strata.operators.resample import oversample
from strata.operators.util import stored


def data(n=300, seed=0, cols=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, cols))
    return x, (x[:, 0] * x[:, 1] + x[:, 2] + 0.5 * rng.normal(size=n) > 0.5).astype(float)


def auc(p, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y > 0] for b in p[y == 0]])


def test_published_settings():
    """Iterations, depth, step, row and column share, leaf limits, penalties."""
    def of(name):
        t = B.PRESETS[name]
        return t.trees, t.depth, t.step, t.rows, t.columns, t.min_rows, t.min_weight, t.min_gain, t.l1, t.l2
    assert of("xgb_v1") == (200, 6, 0.1, 0.8, 0.8, 1, 1.0, 0.0, 0.0, 1.0)
    assert of("xgb_v5") == (400, 4, 0.03, 0.7, 0.7, 1, 10.0, 0.5, 2.0, 5.0)
    assert of("lgb_v5") == (400, 4, 0.03, 0.7, 0.7, 30, 0.0, 0.0, 2.0, 5.0) and B.PRESETS["lgb_v5"].leaves == 15
    assert of("catboost_v5") == (400, 4, 0.03, 1.0, 1.0, 1, 0.0, 0.0, 0.0, 5.0)
    assert of("gb_weights") == (200, 4, 0.03, 0.7, "sqrt", 15, 0.0, 0.0, 0.0, 0.0)
    rf = B.PRESETS["rf_weights"]
    assert (rf.trees, rf.depth, rf.min_rows, rf.min_split, rf.columns, rf.balanced, rf.forest) == (200, 8, 15, 30, "sqrt", True, True)
    levels = {n: (t.trees, t.depth, t.step, t.min_rows, t.l1, t.l2, t.rows, t.columns) for n, t in B.REG_LEVELS.items()}
    assert levels == {"none": (200, 10, 0.1, 5, 0.0, 0.0, 1.0, 1.0), "weak": (400, 6, 0.05, 20, 0.5, 2.0, 0.8, 0.8),
                      "strong": (400, 4, 0.03, 30, 2.0, 5.0, 0.7, 0.7)}


def test_one_split_is_the_best_split():
    """A single stump with L1 and L2 against a search over all cuts."""
    x, y = data(80, cols=3)
    x = np.round(x, 1)
    s = B.Trees(1, 1, 1.0, l1=0.3, l2=2.0)
    m = B.fit_trees(x, y, np.ones(80), s)
    base = np.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + np.exp(-base))
    g, h = p - y, np.full(80, p * (1 - p))

    def part(i):
        soft = np.sign(g[i].sum()) * max(abs(g[i].sum()) - 0.3, 0)
        return soft ** 2 / (h[i].sum() + 2), -soft / (h[i].sum() + 2)
    cuts = [(f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, B.BINS + 1)[1:-1], method="lower"))]
    best = max(cuts, key=lambda fc: part(x[:, fc[0]] <= fc[1])[0] + part(x[:, fc[0]] > fc[1])[0])
    left = x[:, best[0]] <= best[1]
    want = base + np.where(left, part(left)[1], part(~left)[1])
    assert B.predict(m, x) == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-12)


def test_limits_hold():
    x, y = data()
    for s in (B.Trees(3, 4, min_rows=25), B.Trees(3, 5, leaves=4)):
        for tree in B.fit_trees(x, y, np.ones(300), s)["trees"]:
            leaves = [i for i, t in enumerate(tree) if t[2] < 0]
            assert len(leaves) <= s.leaves
            at = B.walk(B.binned(x, B.fit_trees(x, y, np.ones(300), s)["edges"]), [[*t[:3], float(i)] for i, t in enumerate(tree)])
            assert min(np.unique(at, return_counts=True)[1]) >= s.min_rows


def test_models_learn_and_calibrate():
    x, y = data(500)
    xt, yt = data(400, 9)
    w = np.ones(500)
    for s in (B.PRESETS["lgb_v5"], B.PRESETS["rf_weights"], replace(B.PRESETS["lgb_v5"], select=B.PRESETS["lgb_selector"])):
        assert auc(B.predict(B.fit_trees(x, y, w, s), xt), yt) > 0.8
    raw = B.PRESETS["lgb_v5"]
    for kind in ("isotonic", "sigmoid"):
        p = B.predict(B.fit_trees(x, y, w, replace(raw, calibrate=kind)), xt)
        assert auc(p, yt) > 0.8 and ((p - yt) ** 2).mean() < ((B.predict(B.fit_trees(x, y, w, raw), xt) - yt) ** 2).mean() + 0.02
    number = x[:, 0] * 2 + x[:, 1]
    for s in B.REGRESSORS.values():
        p = B.predict(B.fit_trees(x, number, w, s), xt)
        assert ((p - xt[:, 0] * 2 - xt[:, 1]) ** 2).mean() < 0.35 * number.var()


def test_curves():
    p = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    y = np.array([0.0, 1.0, 0.0, 0.0, 1.0, 1.0])
    at, values = B.isotonic(p, y)
    assert at.tolist() == [0.1, 0.2, 0.3, 0.4, 0.5] and values == pytest.approx([0, 1 / 3, 1 / 3, 1, 1])
    a, b = B.platt(p, y)
    q = 1 / (1 + np.exp(-(a * p + b)))
    t = np.where(y > 0, 4 / 5, 1 / 5)
    assert (q - t).sum() == pytest.approx(0, abs=1e-6) and ((q - t) * p).sum() == pytest.approx(0, abs=1e-6)


def frame(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.normal() + (i % 3 == 0)), float(rng.normal()), "+" if i % 2 else "-", float(rng.exponential()),
             None if i % 7 == 0 else int(rng.integers(1, 4)), int(rng.integers(1, 9)), float(rng.random()), float(rng.random()),
             float(rng.normal()), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, A double, B double, C string, D double, E int, F int, G double, H double, "
                                       "I double, target int")


RAW = ["A", "B", "D", "E", "F", "G", "H", "I"]


def test_fits_do_not_depend_on_partitions(spark):
    x, y = data(200)
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, x array<double>, y double")
    one, many = (B.fit_many({0: df.repartition(n)}, {"m": B.Trees(20, 3, rows=0.7, columns=0.7)}, "k", "y")["m", 0] for n in (1, 7))
    assert (B.predict(one, x) == B.predict(many, x)).all()


def test_plans_are_fitted_inside_the_folds(spark):
    rows = stored(kfold_stratified(frame(spark), 5, "target", "doc_id", 42), "rows")
    plan = FeaturePlan(numeric=RAW, spec=V5_22)
    plans = plan.fit_folds(rows, 5)
    for f in range(6):
        alone = FeaturePlan(numeric=RAW, spec=V5_22).fit(rows.where(F.col("fold") != f))
        assert plans[f].stats["median"] == alone.stats["median"]
        assert plans[f].stats.get("bins") == alone.stats.get("bins")


def test_a_leaking_fit_differs(spark):
    """An extreme value in fold 0 moves the statistics of a plan that sees it."""
    rows = kfold_stratified(frame(spark), 5, "target", "doc_id", 42)
    rows = stored(rows.withColumn("E", F.when((F.col("fold") == 0) & F.col("E").isNotNull(), F.lit(1000)).otherwise(F.col("E"))), "rows")
    s = V.setup(rows, 5, "doc_id", "target", FeaturePlan(numeric=RAW, spec=()))
    inside, leaking = s.plans[0].stats["median"]["E"], s.plans[5].stats["median"]["E"]
    assert inside <= 3 and leaking >= inside
    held = s.held_rows(0).collect()
    at = s.cols.index("E")
    assert {r["x"][at] for r in held} <= {1000.0, inside}


def test_out_of_fold_and_stack(spark):
    rows = kfold_stratified(frame(spark), 5, "target", "doc_id", 42)
    rows = stored(kfold_stratified(rows, 3, "target", "doc_id", 43, fold_col="inner"), "rows")
    test = stored(frame(spark, 30, 5).drop("target"), "test")
    s = V.setup(rows, 5, "doc_id", "target", FeaturePlan(numeric=RAW, spec=()), test)
    two = {"small": B.Trees(10, 2), "forest": B.Trees(10, 3, columns="sqrt", forest=True)}
    oof, models = V.out_of_fold(s, {**two, "line": V.logistic(1.0)})
    got = oof.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("k")).collect()
    assert sorted(map(tuple, got)) == [("forest", 120, 120), ("line", 120, 120), ("small", 120, 120)]
    folds = {r["doc_id"]: r["fold"] for r in rows.collect()}
    assert all(folds[r["doc_id"]] == r["fold"] for r in oof.collect())
    assert V.test_scores(s, models).count() == 90
    stacked, scored = V.stack(s, two, 0.1, inner=3)
    assert {r["model"]: r["count"] for r in stacked.groupBy("model").count().collect()} == {"small": 120, "forest": 120, "stack": 120}
    assert scored.count() == 30 and scored.where("p between 0 and 1").count() == 30


def test_penalty_is_divided_by_the_rows_fitted(spark):
    df = V.vectors(spark.createDataFrame([(0, [0.0], 0.0), (1, [1.0], 1.0), (2, [2.0], 1.0), (3, [0.5], 0.0)],
                                         "k long, x array<double>, label double"))
    assert V.logistic(0.5)(df).getRegParam() == pytest.approx(1 / (0.5 * 4))
    assert V.logistic(0.5)(df.where("k < 3")).getRegParam() == pytest.approx(1 / (0.5 * 3))


def test_oversampling_lies_between_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    rows = [(i, [float(v) for v in a], int(i < 45)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x array<double>, y int")
    one, many = (oversample(df.repartition(n), "k", "y").where("synthetic").collect() for n in (1, 5))
    assert len(one) == 30 and all(r["y"] == 0 for r in one)
    assert sorted(r["x"] for r in one) == sorted(r["x"] for r in many)
    small = x[45:]
    d = ((small[:, None] - small[None]) ** 2).sum(axis=2)
    near = np.argsort(np.where(np.eye(15, dtype=bool), np.inf, d), axis=1)[:, :5]
    for r in one:
        p = np.array(r["x"])
        ok = False
        for i in range(15):
            for j in near[i]:
                way = small[j] - small[i]
                t = (p - small[i]) @ way / (way @ way)
                ok |= -1e-9 <= t <= 1 + 1e-9 and np.abs(small[i] + t * way - p).max() < 1e-9
        assert ok
    assert oversample(df.where("y = 1"), "k", "y").where("synthetic").count() == 0


@pytest.mark.parametrize("setting", [B.Trees(1, 5, rows=0.6, columns=0.5, min_rows=3), B.Trees(1, 4, columns="sqrt", min_rows=2, min_split=8),
                                     B.Trees(1, 6, leaves=9, l1=0.2, l2=1.0, min_weight=0.5)])
def test_growing_tells_the_leaf_of_every_row(setting):
    """The leaves that a tree is grown with, for used and unused rows, are those that walking it finds,
    and a leaf's value is that of its used rows."""
    x, y = data(400)
    b = B.binned(x, [np.quantile(x[:, f], np.linspace(0, 1, 30)[1:-1]) for f in range(6)])
    rng, gains = np.random.default_rng(5), np.zeros(6)
    g, h, use = 0.4 - y, np.full(400, 0.24), rng.random(400) < 0.7
    tree, at = B.grow(b, g, h, use, setting, rng, gains)
    assert len(tree) > 3 and gains.sum() > 0
    assert (B.walk(b, [[*t[:3], float(i)] for i, t in enumerate(tree)]) == at).all()
    for leaf in np.unique(at):
        own = use & (at == leaf)
        soft = np.sign(g[own].sum()) * max(abs(g[own].sum()) - setting.l1, 0)
        assert tree[leaf][2] == -1 and tree[leaf][3] == pytest.approx(-soft / (h[own].sum() + setting.l2))
