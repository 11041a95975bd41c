"""Stacks of logistic models against MLlib's fits, one by one, and a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import boosting as B
from strata.operators import ensemble as EN
from strata.operators import models as M
from strata.operators import newton
from strata.operators.stacking import MEAN, STACK, cross_fit
from strata.operators.util import stored
from strata.operators.validate import balanced_weight, vectors

K = 3
BASES = {"two": newton.Logistic(0.5, balanced=True, columns=(0, 1)), "last": newton.Logistic(2.0, columns=(3,)),
         "all": newton.Logistic(5.0)}
META = newton.Logistic(0.3, balanced=True)


def frame(spark, n=450, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 2, 0.3, 1]
    y = (x[:, 0] - 0.4 * x[:, 1] + 0.8 * x[:, 3] + rng.normal(size=n) > 0.7).astype(int)
    return spark.createDataFrame([(i, a.tolist(), int(b), i % K) for i, (a, b) in enumerate(zip(x, y))], "k long, x array<double>, y int, fold int")


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def mllib(df, m, columns):
    """(intercept, coefficients) of MLlib on the columns."""
    own = df.withColumn("x", F.array(*[F.col("x")[i] for i in columns])).withColumn("label", F.col("y").cast("double"))
    own = balanced_weight(own, "y") if m.balanced else own
    got = M.logistic(C=m.c, n=own.count(), weight="weight" if m.balanced else None, tol=1e-13).fit(vectors(own))
    return got.intercept, got.coefficients.toArray()


def test_like_fits_one_by_one(spark):
    df = stored(frame(spark).repartition(5), "rows")
    oof, stack = cross_fit(df, BASES, META, K, 4, "k", "y")
    got = {(r["k"], r["model"]): r["p"] for r in oof.collect()}
    rows = df.collect()
    assert set(got) == {(r["k"], m) for r in rows for m in [*BASES, MEAN, STACK]}
    level1 = {r["k"]: [] for r in rows}
    for name, m in BASES.items():
        cols = m.columns or (0, 1, 2, 3)
        for f in range(K):
            b0, b = mllib(df.where(F.col("fold") != f), m, cols)
            for r in rows:
                if r["fold"] == f:
                    p = sigmoid(b0 + np.array(r["x"])[list(cols)] @ b)
                    level1[r["k"]].append(p)
                    assert got[r["k"], name] == pytest.approx(p, abs=1e-6)
    for key, p in level1.items():
        assert got[key, MEAN] == pytest.approx(np.mean(p), abs=1e-6)
    second = stored(spark.createDataFrame([(r["k"], [float(p) for p in level1[r["k"]]], r["y"], r["fold"]) for r in rows],
                                          "k long, x array<double>, y int, fold int"), "second")
    for f in range(K):
        b0, b = mllib(second.where(F.col("fold") != f), META, range(len(BASES)))
        for r in rows:
            if r["fold"] == f:
                assert got[r["k"], STACK] == pytest.approx(sigmoid(b0 + np.array(level1[r["k"]]) @ b), abs=1e-5)
    # new rows: base models and meta-model of all rows
    base = [mllib(df, m, m.columns or range(4)) for m in BASES.values()]
    top = mllib(second, META, range(len(BASES)))
    for r in stack.predict(df.limit(20)).collect():
        p = [sigmoid(b0 + np.array(r["x"])[list(m.columns or range(4))] @ b) for m, (b0, b) in zip(BASES.values(), base)]
        assert r["p"] == pytest.approx(sigmoid(top[0] + np.array(p) @ top[1]), abs=1e-5)


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    """Turning the labels of fold 0 leaves the base predictions of fold 0 as they were."""
    df = frame(spark)
    turned = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    one, two = ({(r["k"], r["model"]): r["p"] for r in cross_fit(stored(d, "rows"), BASES, META, K, 4, "k", "y")[0].where(
        F.col("fold") == 0).where(F.col("model") != STACK).collect()} for d in (df, turned))
    assert len(one) == 150 * 4 and all(one[at] == pytest.approx(two[at], abs=1e-12) for at in one)


def test_cases(spark):
    """Null features, a split without both classes, no rows."""
    df = frame(spark, 90).withColumn("x", F.when(F.col("k") == 7, F.lit(None)).otherwise(F.col("x")))
    got = {(r["k"], r["model"]): r["p"] for r in cross_fit(stored(df, "rows"), BASES, META, K, 4, "k", "y")[0].collect()}
    assert all((p is None) == (k == 7) for (k, _), p in got.items())
    one_class = df.withColumn("y", (F.col("fold") == 0).cast("int"))
    got = cross_fit(stored(one_class, "rows"), BASES, META, K, 4, "k", "y")[0]
    assert got.where("fold = 0 and p is not null").count() == 0 and got.where("fold = 1 and p is null").where("k <> 7").where(
        F.col("model").isin(list(BASES))).count() == 0
    assert cross_fit(stored(df.limit(0), "rows"), BASES, META, K, 4, "k", "y")[0].count() == 0


def test_calibrations_are_fitted_on_the_other_folds(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p ** 2).astype(int)
    fold = np.arange(300) % K
    df = stored(spark.createDataFrame([(i, float(a), int(b), int(f)) for i, (a, b, f) in enumerate(zip(p, y, fold))],
                                      "k long, p double, y int, fold int").repartition(4), "scores")
    got = {(r["kind"], r["k"]): r["p"] for r in EN.cross_calibrated(df, "y", K).collect()}
    assert len(got) == 900
    for f in range(K):
        fit, held = fold != f, np.flatnonzero(fold == f)
        points, (a, b) = B.isotonic(p[fit], y[fit].astype(float)), B.platt(p[fit], y[fit].astype(float))
        for i in held:
            assert got["raw", i] == p[i]
            assert got["isotonic", i] == pytest.approx(np.interp(p[i], *points), abs=1e-9)
            assert got["sigmoid", i] == pytest.approx(sigmoid(a * p[i] + b), abs=1e-4)
    assert EN.cross_calibrated(df.limit(0), "y", K).count() == 0


def test_forests_are_fitted_on_all_rows(spark, monkeypatch):
    """The bound on the rows of a boosted fit is no bound on a forest's."""
    from strata.operators import validate as V
    monkeypatch.setattr(B, "FIT_ROWS", 4)
    df = frame(spark, 300).withColumn("heavy", F.when(F.col("y") == 1, 20.0).otherwise(1.0))
    df = stored(df, "rows")
    s = V.Setup(df, K, "k", "y", [], [])
    forest = B.Trees(20, 4, columns="sqrt", min_rows=3, forest=True)
    frames = {0: df.where("fold <> 0").select("k", "y", "x", "heavy")}
    plain, even = (V.fit(s, {"rf": t}, (), frames=frames) for t in (forest, B.Trees(20, 4, columns="sqrt", min_rows=3, forest=True, balanced=True)))
    held = df.where("fold = 0").select("k", "y", "x")
    rows = plain.score(held, "rf", 0).collect()
    order = [(a["p"] > b["p"]) + 0.5 * (a["p"] == b["p"]) for a in rows for b in rows if a["y"] > b["y"]]
    assert np.mean(order) > 0.8
    mean = [m.score(held, "rf", 0).agg(F.avg("p")).first()[0] for m in (plain, even, V.fit(s, {"rf": forest}, (), "heavy", frames))]
    assert mean[0] < mean[1] < mean[2]  # weights reach the fit
    assert len(V.feature_importance(plain.mllib["rf", 0], ["a", "b", "c", "d"])) == 4
