import random

import numpy as np
import pytest

from strata.operators.metrics import regression_metrics, roc_auc


def brute_auc(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 30)), rng.randint(0, 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, s double, g int")
    got = {r["g"]: r["auc"] for r in roc_auc(df, "y", "s", ["g"]).collect()}
    for g in range(3):
        sub = [r for r in rows if r[2] == g]
        assert got[g] == pytest.approx(brute_auc([r[0] for r in sub], [r[1] for r in sub]), abs=1e-12)


def test_auc_edge_cases(spark):
    ties = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "y int, s double")
    assert roc_auc(ties, "y", "s").first()["auc"] == 0.5
    one = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, s double")
    assert roc_auc(one, "y", "s").first()["auc"] is None
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double")
    assert roc_auc(perfect, "y", "s").first()["auc"] == 1.0


def test_auc_with_null_groups_and_scores(spark):
    rows = [(i % 2, float(i % 5), None if i % 3 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, s double, g int")
    got = {r["g"]: r["auc"] for r in roc_auc(df, "y", "s", ["g"]).collect()}
    for g in (None, 1, 2):
        sub = [r for r in rows if r[2] == g]
        assert got[g] == pytest.approx(brute_auc([r[0] for r in sub], [r[1] for r in sub]), abs=1e-12)
    with pytest.raises(Exception, match="null score"):
        roc_auc(spark.createDataFrame([(1, None), (0, 1.0)], "y int, s double"), "y", "s").collect()


def test_regression_metrics(spark):
    y = np.array([1.0, 2.0, 3.0, 4.0])
    p = np.array([1.5, 2.0, 2.0, 5.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    assert r["mse"] == pytest.approx(np.mean((y - p) ** 2))
    assert r["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert r["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert r["max_abs_err"] == pytest.approx(1.0)
