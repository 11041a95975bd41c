import numpy as np
import pytest

from strata.operators import models as M
from strata.operators.ensemble import isotonic_apply, isotonic_fit


def _frame(spark, X, y, w=None):
    rows = [tuple(float(v) for v in x) + (float(t),) + ((float(w[i]),) if w is not None else ())
            for i, (x, t) in enumerate(zip(X, y))]
    cols = [f"x{i}" for i in range(X.shape[1])]
    schema = ", ".join(f"{c} double" for c in cols) + ", label double" + (", w double" if w is not None else "")
    return M.assemble(spark.createDataFrame(rows, schema), cols)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.5, size=200)
    alpha = 10.0
    m = M.ridge(alpha, len(y), y.std(), "label").fit(_frame(spark, X, y))
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-8)
    assert m.intercept == pytest.approx(y.mean() - X.mean(0) @ w, abs=1e-8)


def test_lasso_matches_coordinate_descent(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 4))
    y = X @ np.array([2.0, 0.0, -1.0, 0.1]) + rng.normal(scale=0.3, size=300)
    alpha = 0.1
    m = M.lasso(alpha, "label").fit(_frame(spark, X, y))
    Xc, yc = X - X.mean(0), y - y.mean()
    n, w = len(y), np.zeros(4)
    for _ in range(2000):
        for j in range(4):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (Xc[:, j] @ Xc[:, j] / n)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-5)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(X @ np.array([1.0, -2.0]) + 0.3)))).astype(float)
    C = 0.1
    m = M.logistic(C=C, n=len(y), label="label", tol=1e-10).fit(_frame(spark, X, y))
    A = np.hstack([X, np.ones((400, 1))])
    b = np.zeros(3)
    for _ in range(50):   # minimise C*sum(logloss) + 0.5*||w||^2 (intercept unpenalised)
        p = 1 / (1 + np.exp(-A @ b))
        reg = np.array([1.0, 1.0, 0.0])
        g = C * A.T @ (p - y) + reg * b
        H = C * (A.T * (p * (1 - p))) @ A + np.diag(reg)
        b -= np.linalg.solve(H, g)
    assert np.allclose(np.append(m.coefficients.toArray(), m.intercept), b, atol=1e-5)


def test_isotonic_matches_pava(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(np.arange(10) / 10.0, 20)
    y = (rng.random(200) < 0.1 + 0.6 * x).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    model = isotonic_fit(df, "x", "y")
    lv = spark.createDataFrame([(float(v),) for v in np.arange(10) / 10.0], "x double")
    got = [r["p_cal"] for r in isotonic_apply(model, lv, "x").orderBy("x").collect()]
    # pool-adjacent-violators on level means
    blocks = [[y[x == v].mean(), float((x == v).sum())] for v in np.arange(10) / 10.0]
    merged = []
    for m_, w_ in blocks:
        merged.append([m_, w_, 1])
        while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
            b2, b1 = merged.pop(), merged.pop()
            wt = b1[1] + b2[1]
            merged.append([(b1[0] * b1[1] + b2[0] * b2[1]) / wt, wt, b1[2] + b2[2]])
    exp = [m_ for m_, _, c in merged for _ in range(c)]
    assert got == pytest.approx(exp, abs=1e-12)


def test_tree_regressors_read_all_rows(spark, monkeypatch):
    """The bound of the bounded fits doesn't reach the regressors."""
    from pyspark.sql import functions as F
    from strata.operators import boosting as B
    from strata.plans import q_regression as Q
    monkeypatch.setattr(B, "FIT_ROWS", 2)
    df = spark.range(2000).select(F.col("id").alias("p_partkey"), (F.col("id") % 5).cast("int").alias("fold"),
                                  (F.col("id") % 100 / 10).alias("W0"), (F.col("id") % 7).cast("double").alias("W1")) \
        .withColumn("y", F.col("W0") + F.col("W1"))
    settings = {"forest": B.Trees(5, 6, forest=True, squared=True), "boosted": B.Trees(5, 3, 0.1, squared=True)}
    errors = Q.held_out_errors(df, [], settings).collect()
    assert len(errors) == 10 and all(r["mse"] < 2 for r in errors)
