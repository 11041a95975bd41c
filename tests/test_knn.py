"""Exact neighbours against brute force, and points between them."""

import numpy as np
import pytest

from strata.operators import knn
from strata.operators.resample import oversample, synthetic


def plain(keys, x, k):
    """[(key, nth, neighbour)] by comparing every pair, ties to smaller keys."""
    out = []
    for s in range(0, len(x), 500):
        d = knn.squared(x[s:s + 500], x)
        for i, row in enumerate(d, s):
            near = np.argpartition(row, min(k + 1, len(x) - 1))[:k + 2] if len(x) > 200 else np.arange(len(x))
            far = row[near].max()
            near = np.flatnonzero(row <= far)
            order = [j for j in near[np.lexsort((keys[near], row[near]))] if j != i][:k]
            out += [(int(keys[i]), n + 1, int(keys[j])) for n, j in enumerate(order)]
    return sorted(out)


def frame(spark, keys, x):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({"key": keys, "x": x.tolist()}), "key long, x array<double>")


@pytest.mark.parametrize("kind", ["spread", "line", "copies", "few"])
def test_neighbours(spark, kind, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 64)
    monkeypatch.setattr(knn, "CHUNK", 50)
    monkeypatch.setattr(knn, "VISITORS", 40)
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=(1500, 4)), "line": np.c_[np.arange(900) // 3, np.zeros(900)].astype(float),
         "copies": np.r_[np.zeros((400, 3)), rng.integers(0, 4, size=(500, 3))].astype(float), "few": rng.normal(size=(4, 2))}[kind]
    keys = rng.permutation(len(x)) * 7 - 100
    got = knn.nearest(frame(spark, keys, x).repartition(4), 5)
    assert sorted((r["key"], r["nth"], r["neighbour"]) for r in got.collect()) == plain(keys, x, 5)
    near = {r["key"]: r["d2"] for r in got.collect() if r["nth"] == 1}
    at = {int(k): v for k, v in zip(keys, x)}
    assert all(d >= 0 for d in near.values()) and set(near) == set(at)


def test_twenty_five_thousand_rows_in_close_pairs(spark):
    """The neighbour of every row is its twin, wherever the rows lie."""
    rng = np.random.default_rng(6)
    half = rng.normal(size=(12_500, 6))
    x = np.concatenate([half, half + 1e-6])
    got = knn.nearest(frame(spark, np.arange(25_000), x), 1).collect()
    assert len(got) == 25_000 and all(abs(r["neighbour"] - r["key"]) == 12_500 for r in got)


def test_neighbour_cases(spark):
    rows = [(1, [0.0, -0.0]), (2, [-0.0, 0.0]), (3, [1.0, None]), (4, None), (None, [0.0, 0.0]), (5, [float("nan"), 0.0]), (6, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "key long, x array<double>").selectExpr("*", "1 as point", "2 as cell", "3 as nth")
    got = sorted((r["key"], r["nth"], r["neighbour"], r["d2"]) for r in knn.nearest(df, 2).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 6, 25.0), (2, 1, 1, 0.0), (2, 2, 6, 25.0), (6, 1, 1, 25.0), (6, 2, 2, 25.0)]
    assert knn.nearest(df.limit(0), 2).count() == 0 and knn.nearest(df.where("key = 6"), 2).count() == 0


def test_every_row_is_a_seed(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    df = frame(spark, np.arange(30), x)
    got = synthetic(df, 100, "key").collect()
    seeds = np.bincount([r["key"] for r in got], minlength=30)
    assert len(got) == 100 and set(seeds) == {3, 4}
    near = {(a, c) for a, _, c in plain(np.arange(30), x, 5)}
    for r in got:
        assert (r["key"], r["neighbour"]) in near
        a, b, p = x[r["key"]], x[r["neighbour"]], np.array(r["x"])
        t = (p - a) @ (b - a) / ((b - a) @ (b - a))
        assert -1e-12 <= t < 1 and p == pytest.approx(a + t * (b - a), abs=1e-12)
    one = df.where("key = 3").selectExpr("key", "x", "1 as y").unionByName(df.where("key > 20").selectExpr("key", "x", "0 as y"))
    alone = oversample(one, "key", "y").where("synthetic").collect()
    assert len(alone) == 8 and all(r["x"] == x[3].tolist() and r["y"] == 1 for r in alone)
