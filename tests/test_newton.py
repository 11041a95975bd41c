"""Many logistic regressions against MLlib's, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import models as M
from strata.operators import newton
from strata.operators.util import stored
from strata.operators.validate import balanced_weight, vectors


def frame(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1]
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n) > 0.8).astype(int)
    return spark.createDataFrame([(a.tolist(), int(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y int, fold int")


def test_like_mllib(spark):
    df = stored(frame(spark).repartition(5), "rows")
    models = {f"{c} {held} {balanced}": newton.Logistic(c, held, balanced)
              for c in (0.05, 10.0) for held in (None, 1) for balanced in (False, True)}
    got = newton.fit(df, models, "y")
    for name, m in models.items():
        seen = df if m.held is None else df.where(F.col("fold") != m.held)
        seen = balanced_weight(seen.withColumn("label", F.col("y").cast("double")), "y") if m.balanced else seen.withColumn("label", F.col("y").cast("double"))
        theirs = M.logistic(C=m.c, n=seen.count(), weight="weight" if m.balanced else None, tol=1e-13).fit(vectors(seen))
        assert got[name][0] == pytest.approx(theirs.coefficients.toArray(), abs=1e-6), name
        assert got[name][1] == pytest.approx(theirs.intercept, abs=1e-6), name


def test_step_control_and_cases(spark):
    """Far-apart scales, separable rows under a weak penalty, a fit without a class."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(-4, 1, 60), rng.normal(4, 1, 6)]
    df = spark.createDataFrame([([float(v) * 1000], int(i >= 60), int(i >= 60)) for i, v in enumerate(x)] + [([None], 1, 0), (None, 1, 0), ([1.0], None, 0)],
                               "x array<double>, y int, fold int")
    got = newton.fit(stored(df, "rows"), {"weak": newton.Logistic(1e6), "none": newton.Logistic(1.0, held=1)}, "y")
    assert got["none"] is None
    b, b0 = got["weak"]
    p = 1 / (1 + np.exp(-np.clip(x * 1000 * b[0] + b0, -700, 700)))
    y = np.arange(66) >= 60
    assert np.abs((x * 1000 * (p - y)).sum() + b[0] / 1e6) < 1e-3 and abs((p - y).sum()) < 1e-6
    assert newton.fit(stored(df.limit(0), "rows"), {"a": newton.Logistic(1.0)}, "y") == {"a": None}
