import random

import numpy as np
import pandas as pd
import pytest

from strata.functions.columns import equal_width_bin
from strata.operators.features import RobustScaler
from strata.operators.quantiles import exact_quantiles


def test_equal_width_bins_match_pandas_cut(spark):
    rng = random.Random(7)
    vals = [round(rng.uniform(-3, 9), 1) for _ in range(2000)] + [-3.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    lo, hi = min(vals), max(vals)
    got = [r[0] for r in df.select(equal_width_bin("x", lo, hi, 5)).collect()]
    exp = pd.cut(pd.Series(vals), bins=5, labels=False).tolist()
    assert got == exp


def test_exact_quantiles_multi_round(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(5, 5000), np.full(3000, 2.5)])   # heavy value + tail
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    q = exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.99])["x"]
    assert q == pytest.approx(np.quantile(x, [0.1, 0.25, 0.5, 0.75, 0.99]), abs=1e-12)


def test_exact_quantiles_with_nan_and_infinities(spark):
    rows = [(float(i), i / 3) for i in range(1000)] + [(float("nan"), None), (None, float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.5, 1.0])
    assert got["x"] == [499.5, 999.0] and got["y"] == pytest.approx([499.5 / 3, 333.0])
    inf = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (1e300,), (float("inf"),)], "x double")
    assert exact_quantiles(inf, ["x"], [0.0, 0.5, 1.0])["x"] == [float("-inf"), 2.0, float("inf")]
    assert exact_quantiles(inf.where("x > 3e300 and x < 0"), ["x"], [0.5])["x"] == [None]


def test_exact_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [2.5]


def test_robust_scaler_zero_iqr(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0)], "a double, c double")
    rs = RobustScaler(["a", "c"]).fit(df)
    assert rs.stats["c"] == (0.0, 1.0)
    out = rs.transform(df).toPandas()
    assert out.c.tolist() == [0.0] * 4
    assert out.a.tolist() == pytest.approx(((np.array([1, 2, 3, 4]) - 2.5) / 1.5).tolist())


def test_words_are_ascii_runs_of_letters_and_digits(spark):
    """The class of the splitting pattern, on marks, underscores, accents, surrogate pairs, nulls and empty texts."""
    from pyspark.sql import functions as F

    from strata.functions import text as T
    texts = ["", " ", "a_b", "Café İx9", "\U0001F600a\U0001F600b", "x\n\ty zK", "_", "A1-b2" * 50, None,
             *["".join(map(chr, range(i, i + 64))) for i in (0, 64, 128, 256)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    w = T.normalised_words(F.col("t"))
    got = {r["i"]: r for r in df.select("i", w.alias("w"), T.mean_word_length(F.col("t"), w).alias("m")).collect()}
    import re
    for i, t in enumerate(texts):
        words = None if t is None else re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]", " ", t).lower())
        assert got[i]["w"] == words
        if words:
            assert got[i]["m"] == pytest.approx(sum(map(len, words)) / len(words))
    assert not re.search(r"\[\^", T.WORD_SPLIT)  # a negated class of ranges takes Java's matcher six times as long
