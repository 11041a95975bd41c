"""Bounds of many AUCs and the race among blends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import ensemble as EN


def preds(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows = []
    for m, noise in (("a", 0.2), ("b", 0.4), ("c", 0.9)):
        p = 1 / (1 + np.exp(-(y - 0.5 + noise * 3 * rng.normal(size=n))))
        rows += [(i, int(y[i]), m, float(np.round(p[i], 2 if m == "c" else 9))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, model string, p double")


def test_race_has_the_winner(spark):
    df = preds(spark)
    cw = EN.candidate_weights(spark, ["a", "b", "c"], 120)
    full = EN.blend_search(df, "k", "y", ["a", "b", "c"], candidates=cw)
    race = EN.blend_race(df, "k", "y", ["a", "b", "c"], cw)
    assert EN.best_candidate(race).first() == EN.best_candidate(full).first()
    exact = {r["cand"]: r["auc"] for r in full.collect()}
    left = {r["cand"]: r["auc"] for r in race.collect()}
    assert left == {c: exact[c] for c in left} and len(left) < 60


def test_bounds_hold(spark):
    scored = EN.blended(preds(spark), "k", "y", ["a", "b", "c"], EN.candidate_weights(spark, ["a", "b", "c"], 30), 12)
    exact = {r["cand"]: r["auc"] for r in EN.auc_of(scored).collect()}
    for classes in (1, 7, 1024):
        for r in EN.auc_bounds(scored, classes).collect():
            assert r["low"] - 1e-12 <= exact[r["cand"]] <= r["high"] + 1e-12


def test_race_without_a_class(spark):
    df = preds(spark).withColumn("y", F.lit(1))
    got = EN.blend_race(df, "k", "y", ["a", "b", "c"], EN.candidate_weights(spark, ["a", "b", "c"], 4)).collect()
    assert sorted(r["cand"] for r in got) == [0, 1, 2, 3] and all(r["auc"] == pytest.approx(0) for r in got)
