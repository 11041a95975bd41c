"""Forests from sums per cell of bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import boosting as B
from strata.operators import forests as FO
from strata.operators import models as M
from strata.operators.util import stored


def table(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 9, n).astype(float)
    rows = [(i, i % 3, float(u), float(v), float(2 * u + v * v / 8)) for i, (u, v) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "k long, fold int, a double, b double, y double")


def test_cells_give_the_tree_that_rows_give():
    rng = np.random.default_rng(1)
    x, y, times = rng.integers(0, 6, (500, 2)).astype(np.uint8), rng.normal(size=500), rng.poisson(1, 500).astype(float)
    edges = [np.arange(5) + 0.5] * 2
    cell = FO.cell_of([x[:, 0].astype(float), x[:, 1].astype(float)], edges)
    bins = FO.cell_bins(edges)
    assert (bins[cell] == x).all()
    n, s = (np.bincount(cell, w, len(bins)) for w in (times, times * y))
    setting = B.Trees(1, 5, forest=True, squared=True)
    by_rows, at = B.grow(x, -times * y, times, times > 0, setting, np.random.default_rng(0), np.zeros(2))
    by_cells, at_cell = B.grow(bins, -s, n, n > 0, setting, np.random.default_rng(0), np.zeros(2), rows=n)
    p, q = np.array([t[3] for t in by_rows])[at], np.array([t[3] for t in by_cells])[at_cell][cell]
    assert len(by_rows) > 20 and p == pytest.approx(q, abs=1e-9)


def test_cuts():
    assert FO.cuts([1.0, 1.0, 2.0, 4.0], 32).tolist() == [1.5, 3.0]  # all that there are
    got = FO.cuts(np.linspace(0, 1, 1000).tolist(), 32)
    assert len(got) == 31 and np.abs(got - np.arange(1, 32) / 32).max() < 2e-3
    assert len(FO.cuts(None, 32)) == 0


def test_all_rows_count_and_the_held_fold_does_not(spark):
    """The sums of all tasks are those of the drawn rows outside the held fold, with about as many drawn as there are."""
    df = stored(table(spark).repartition(3), "rows")
    edges = {0: [np.array([0.0]), np.array([3.5])], 1: [np.array([]), np.array([3.5])]}
    got = FO.cell_sums(df, ["a", "b"], "y", {"f": B.Trees(50, 3, forest=True, squared=True)}, edges, {0: 0, 1: None}).collect()
    n = {f: sum(np.frombuffer(r["n"]).sum() for r in got if r["split"] == f) / 50 for f in (0, 1)}
    assert n[0] == pytest.approx(400, rel=0.05) and n[1] == pytest.approx(600, rel=0.05)
    assert {len(r["n"]) // 8 for r in got if r["split"] == 0} == {4}


def test_forests_need_one_pass(spark, monkeypatch):
    """A forest isn't a fit of many small jobs: it failed by time on 1.2 million rows. Deep and shallow ones of
    several folds come from the same pass over the rows, and predict rows that they weren't fitted on."""
    from strata.plans import q_regression as Q
    passes, sums = [], FO.cell_sums
    monkeypatch.setattr(FO, "cell_sums", lambda *a: passes.append(1) or sums(*a))
    monkeypatch.setattr(M, "tree_regressor", lambda *a: pytest.fail("a fit per forest"))
    df = spark.range(3000).select(F.col("id").alias("p_partkey"), (F.col("id") % 5).cast("int").alias("fold"),
                                  (F.col("id") % 97 / 10).alias("W0"), (F.col("id") % 7).cast("double").alias("W1")) \
        .withColumn("y", F.col("W0") + F.col("W1") * F.col("W1"))
    errors = Q.held_out_errors(df, [], {"a": B.Trees(10, 4, forest=True, squared=True), "b": B.Trees(20, 12, forest=True, squared=True)})
    got = errors.collect()
    assert len(passes) == 1 and len(got) == 10
    assert all(r["mse"] < (0.2 if r["model"] == "b" else 8) for r in got)


def test_odd_labels_and_features(spark):
    df = table(spark, 60)
    setting = {"f": B.Trees(3, 3, forest=True, squared=True)}
    with pytest.raises(ValueError):
        FO.fit_cells(df.withColumn("y", F.when(F.col("k") > 0, F.col("y"))), ["a", "b"], "y", setting, {0: None})
    with pytest.raises(ValueError):
        FO.fit_cells(df.where("fold = 0"), ["a", "b"], "y", setting, {0: 0})
    odd = df.withColumn("a", F.when(F.col("k") % 7 > 0, F.col("a")))
    got = FO.fit_cells(odd, ["a", "b"], "y", setting, {0: None})
    scored = odd.select(FO.score_cells(got, "f", F.lit(0), ["a", "b"]).alias("p"))
    assert scored.where("p is null or isnan(p)").count() == 0


def test_histogram_counts_drawn_rows_by_node():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 64, (6, 400)).astype(np.uint8), rng.integers(0, 2, 400).astype(np.uint8)
    times = rng.poisson(1, 400)
    own = np.flatnonzero(times)
    nodes = np.array([[2, 4, -1, -1, -1], [30, 10, 0, 0, 0], [1, 3, -1, -1, -1]])  # root, left split again, right a leaf above
    ask = np.array([[0, 5], [1, 3]])
    got = FO.histogram(x, y, own, times[own], nodes, 2, ask).reshape(2, 2, 64, 2)
    for k, under in enumerate((x[4] <= 10, x[4] > 10)):
        for j, f in enumerate(ask[k]):
            for label in (0, 1):
                use = (x[2] <= 30) & under & (y == label)
                assert (got[k, j, :, label] == np.bincount(x[f][use], times[use], 64)).all()


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(4)
    hist = rng.integers(0, 9, (3, 2, 128))
    hist[:, 1] = rng.permuted(hist[:, 0].reshape(3, 64, 2), axis=1).reshape(3, 128)  # the same rows by another feature
    s, w = B.Trees(1, 1, min_rows=40), (0.7, 2.0)

    def gini(c):
        c = c * w
        return c.sum() - (c ** 2).sum() / c.sum() if c.sum() else 0.0
    for node, (j, cut, gain, l0, l1, t0, t1) in zip(hist.reshape(3, 2, 64, 2), FO.best_cuts(hist, s, w)):
        want = max((gini(node[f].sum(axis=0)) - gini(node[f][:c + 1].sum(axis=0)) - gini(node[f][c + 1:].sum(axis=0)), -f, -c)
                   for f in range(2) for c in range(64) if min(node[f][:c + 1].sum(), node[f][c + 1:].sum()) >= 40)
        assert (gain, -j, -cut) == pytest.approx(want) and (t0, t1) == tuple(node[0].sum(axis=0))
        assert (l0, l1) == tuple(node[int(j)][:int(cut) + 1].sum(axis=0))


def classes(spark, n=900):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 6))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.4).astype(int)
    return spark.createDataFrame([(i, int(i % 3), int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                                 "k long, fold int, y int, x array<double>"), x, y


def test_forests_of_all_splits_share_a_pass_per_level(spark, monkeypatch):
    """Thirty-six forests were as many MLlib fits of eight jobs or more, each on a task or two. All rows are read,
    however few a bounded fit may, and neither partitions nor blocks of another order matter."""
    monkeypatch.setattr(B, "FIT_ROWS", 2)
    monkeypatch.setattr(M, "forest", lambda *a, **k: pytest.fail("an MLlib fit"))
    from strata.operators import validate as V
    df, x, y = classes(spark)
    s = B.Trees(25, 5, columns="sqrt", min_rows=3, balanced=True, forest=True)
    levels, level = [], FO.one_level
    monkeypatch.setattr(FO, "one_level", lambda *a: levels.append(a[4]) or level(*a))
    setup = V.Setup(df, 3, "k", "y", [], [])
    frames = {f: df.where(F.col("fold") != f) for f in range(3)}
    got = V.fit(setup, {"rf": s, "small": B.Trees(5, 2, columns="sqrt", forest=True)}, (), frames=frames)
    assert levels == list(range(5)) and got.names() == ["rf", "small"] and len(got.trees) == 6
    for f in range(3):
        held = np.arange(900) % 3 == f
        p = B.predict(got.trees["rf", f], x[held])
        assert np.mean((p > 0.5) == y[held]) > 0.8 and len(got.trees["rf", f]["trees"]) == 25
    again = FO.fit_levels({f: d.repartition(5) for f, d in frames.items()}, {"rf": s}, "k", "y")
    assert (B.predict(again["rf", 1], x) == B.predict(got.trees["rf", 1], x)).all()
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)
    many = FO.fit_levels({0: frames[0]}, {"rf": s}, "k", "y")["rf", 0]
    assert np.corrcoef(B.predict(many, x), B.predict(got.trees["rf", 0], x))[0, 1] > 0.95
    with pytest.raises(ValueError):
        FO.fit_levels({0: df.withColumn("y", F.when(F.col("k") > 0, F.col("y")))}, {"rf": s}, "k", "y")


def test_leaves_of_a_class_are_merged():
    """Upwards, and only where both children are leaves of the same class."""
    nodes = np.array([[3, 1, 2, -1, -1, 4, -1, -1, -1], [9, 8, 7, 0, 0, 6, 0, 0, 0], [1, 3, 5, -1, -1, 7, -1, -1, -1]])
    values = np.array([0.5, 0.2, 0.8, 0.1, 0.3, 0.9, 0.2, 0.7, 0.95])
    FO.merge(nodes, values)
    assert nodes[2].tolist() == [1, -1, 5, -1, -1, -1, -1, -1, -1] and nodes[0].tolist() == [3, -1, 2, -1, -1, -1, -1, -1, -1]
