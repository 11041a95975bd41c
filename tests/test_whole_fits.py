"""Boosted fits read all rows of their split; their sums, bins and scores are those of a plain fit."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import boosting as B
from strata.operators import ensemble as EN
from strata.operators import validate as V

PLAIN = B.Trees(12, 3, rows=0.7, columns=0.7, l2=1.0, balanced=True)


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 3] = x[:, 0] ** 3  # in the same order as the first
    y = (x[:, 0] * x[:, 1] + x[:, 2] + 0.5 * rng.normal(size=n) > 0.5).astype(float)
    w = np.round(rng.random(n) + 0.5, 2)
    rows = [(f"{i:05d}", [float(v) for v in a], int(b), float(c), i % 2) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "k string, x array<double>, y int, w double, fold int").repartition(5), x, y, w


@pytest.mark.parametrize("setting", [PLAIN, replace(PLAIN, calibrate="isotonic"), replace(PLAIN, calibrate="sigmoid", seed=7),
                                     replace(PLAIN, select=B.Trees(5, 2)), replace(PLAIN, select=B.Trees(5, 2), calibrate="sigmoid")])
def test_a_fit_reads_all_rows(spark, monkeypatch, setting):
    """What a task sums at a time bounds no fit: it was the number of rows that a fit read."""
    df, x, y, w = table(spark)
    frames = {0: df, 1: df.where("fold = 1")}
    monkeypatch.setattr(B, "FIT_ROWS", 60)
    got = B.fit_many(frames, {"m": setting, "other": B.Trees(3, 2, seed=1)}, "k", "y", weight="w")
    monkeypatch.undo()
    assert set(got) == {(n, f) for n in ("m", "other") for f in (0, 1)}
    for f, own in ((0, np.arange(400)), (1, np.arange(1, 400, 2))):
        want = B.fit_trees(x[own], y[own], w[own], setting)
        assert (B.predict(got["m", f], x) == B.predict(want, x)).all()
        assert got["m", f]["importance"] == want["importance"]
    if setting.calibrate:
        assert np.ptp(B.predict(got["m", 0], x)) > 0.3


def test_out_of_fold_models_read_all_rows(spark, monkeypatch):
    """Every row outside the fold is fitted on, and all models score a row in one pass."""
    df, x, y, _ = table(spark)
    s = V.Setup(df, 2, "k", "y", [], [])
    monkeypatch.setattr(V.Setup, "features", lambda self, rows, split, is_test=False: rows.select("k", "y", "fold", "x"))
    monkeypatch.setattr(B, "FIT_ROWS", 30)
    settings = {"a": PLAIN, "b": replace(PLAIN, depth=2), "line": V.logistic(1.0)}
    for in_sample in (False, True):
        oof, models = V.out_of_fold(s, settings, in_sample=in_sample)
        rows = {(r["k"], r["fold"], r["model"]): r for r in oof.collect()}
        assert len(rows) == 400 * 3 * (2 if in_sample else 1) and models.names() == ["a", "b", "line"]
        for f in (0, 1):
            fit = np.arange(400) % 2 != f
            for name in ("a", "b"):
                p = B.predict(B.fit_trees(x[fit], y[fit], np.ones(200), settings[name]), x)
                for i in range(400):
                    if in_sample or not fit[i]:
                        r = rows[f"{i:05d}", f, name]
                        assert r["p"] == p[i] and r["y"] == y[i] and (not in_sample or r["seen"] == fit[i])
    one = models.score(df, "a", 0).select("k", "p").collect()
    assert {r["k"]: r["p"] for r in one} == {k: r["p"] for (k, f, m), r in rows.items() if (f, m) == (0, "a")}


def test_columns_of_the_same_bins_are_summed_once(monkeypatch):
    """The first of the asked ones wins, as it does when all are summed."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (300, 4)).astype(np.uint8)
    x[:, 2] = x[:, 0]
    g, h, use = rng.normal(size=300), rng.random(300), rng.random(300) < 0.8
    for s in (B.Trees(1, 4, columns=0.75, min_weight=0.5), B.Trees(1, 4, min_rows=9), B.Trees(1, 4, columns="sqrt")):
        both = []
        for same in (None, np.array([0, 1, 0, 3])):
            gains = np.zeros(4)
            both.append((*B.grow(x, g, h, use, s, np.random.default_rng(4), gains, same=same), gains))
        assert both[0][0] == both[1][0] and (both[0][1] == both[1][1]).all() and (both[0][2] == both[1][2]).all()


def test_modules_sent_to_executors_need_no_others_of_here():
    """Executors have numpy and pyarrow, not this package."""
    from pyspark import cloudpickle
    for sent in (B, B.fit_bins, EN.race_scores):
        assert b"strata.operators.util" not in cloudpickle.dumps(sent)


def test_an_interpolation_needs_corners_only():
    at, values = np.arange(9.0), np.array([0, 0, 0, 0.2, 0.2, 0.5, 0.9, 0.9, 0.9])
    x = np.linspace(-1, 10, 200)
    few = B.corners(at, values)
    assert len(few[0]) == 7 and (np.interp(x, *few) == np.interp(x, at, values)).all()
