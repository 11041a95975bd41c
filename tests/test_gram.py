"""Cross-validation from moments against fits on the rows themselves; concurrent fits."""

import threading

import numpy as np
import pytest

from strata.operators import gram as G
from strata.operators import models as M
from strata.operators.concurrent import at_once
from strata.operators.folds import kfold_contiguous


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [100.0, -3.0, 0.0]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    return x, y


def test_folds_by_subtraction(spark):
    x, y = rows()
    fold = np.arange(len(y)) % 4
    df = spark.createDataFrame([(*map(float, a), float(b), int(f)) for a, b, f in zip(x, y, fold)]
                               + [(None, 1.0, 1.0, 1.0, 0), (float("nan"), 1.0, 1.0, 1.0, 1)], "a double, b double, c double, y double, fold int")
    folds = G.fold_moments(df.repartition(5), ["a", "b", "c"], "y")
    assert [m.n for m in folds.values()] == [100] * 4
    for f, (seen, held, (b, b0)) in G.cross_validated(folds, lambda m: G.ridge(m, 3.0)).items():
        a = np.c_[x[fold != f] - x[fold != f].mean(axis=0)]
        want = np.linalg.solve(a.T @ a + 3 * np.eye(3), a.T @ (y[fold != f] - y[fold != f].mean()))
        assert b == pytest.approx(want, rel=1e-9)
        res = y[fold == f] - b0 - x[fold == f] @ b
        assert G.mse(held, (b, b0)) == pytest.approx((res ** 2).mean(), rel=1e-9)
        assert G.r2(held, (b, b0)) == pytest.approx(1 - (res ** 2).mean() / y[fold == f].var(), rel=1e-9)
        assert seen.n == 300


def test_like_mllib(spark):
    x, y = rows(200, 2)
    df = spark.createDataFrame([(*map(float, a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, y double, i long")
    df = M.assemble(kfold_contiguous(df, 3, ["i"]), ["a", "b", "c"])
    m = G.total(G.fold_moments(df, ["a", "b", "c"], "y"))
    for mine, theirs in ((G.ridge(m), M.linear("y")), (G.ridge(m, 10.0), M.ridge(10.0, 200, float(np.std(y)), "y")),
                         (G.lasso(m, 0.3), M.lasso(0.3, "y"))):
        fit = theirs.fit(df)
        assert mine[0] == pytest.approx(fit.coefficients.toArray(), abs=1e-5) and mine[1] == pytest.approx(fit.intercept, abs=1e-3)


def test_dependent_columns_and_empty(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1, i % 2) for i in range(20)], "a double, b double, y double, fold int")
    m = G.total(G.fold_moments(df, ["a", "b"], "y"))
    assert G.mse(m, G.ridge(m)) == pytest.approx(0, abs=1e-9)
    assert G.fold_moments(df.limit(0), ["a", "b"], "y") == {}
    assert G.cross_validated({0: m}, G.ridge) == {}  # nothing outside the only fold


def test_at_once(spark):
    together = threading.Barrier(3, timeout=60)

    def job(n):
        def run():
            together.wait()  # passes only if three are in flight
            return spark.range(n).count()
        return run
    assert at_once(spark, {n: job(n) for n in (1, 2, 3)}, 3) == {1: 1, 2: 2, 3: 3}

    def broken():
        raise ValueError("no")
    with pytest.raises(ValueError, match="no"):
        at_once(spark, {"a": broken, "b": lambda: 1}, 1)
