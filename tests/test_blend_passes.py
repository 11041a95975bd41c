"""The passes of a blend race: rounding, classes, bounds and exact AUCs against the plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import ensemble as EN

NAMES = ["a", "b", "c"]


def preds(spark, n=600):
    """Good models, whose scores crowd at 0 and 1; some equal rows, a null score, a null label, a key in two labels."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, n)
    rows = []
    for j, m in enumerate(NAMES):
        p = 1 / (1 + np.exp(-(16 * (y - 0.5) + (4 + j) * rng.normal(size=n))))
        p[:40] = np.round(p[:40], 1)
        rows += [(int(i) // 2 if i < 20 else int(i), None if i == 50 else int(y[i]), m, None if i == 60 and m == "b" else float(p[i]))
                 for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, model string, p double").repartition(4)


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(500), rng.integers(0, 10 ** 6, 500) / 10 ** 6 + 5e-8, [0.0, 1.0, 0.5, 1e-13, 2.5e-7, 0.125, 123.4567895]])
    for digits in (2, 7, 12):
        want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(
            F.round("x", digits)).collect()]
        assert EN.rounds(x, digits).tolist() == want


def test_classes_grow_with_the_score():
    x = np.sort(np.concatenate([[-np.inf, -1, 0, 0.5, 1, 2, np.inf], np.random.default_rng(2).random(3000) ** 9, 1 - 10.0 ** -np.arange(13)]))
    got = EN.classes_of(x)
    assert (np.diff(got) >= 0).all() and got.min() == 0 and got.max() == 2 * EN.STEPS * EN.OCTAVES
    assert len(np.unique(got)) > 500


def test_passes_against_plain_forms(spark, monkeypatch):
    """Few candidates are left to be made exactly where even classes leave all; no pass has a row per candidate and score."""
    df, cw = preds(spark), EN.candidate_weights(spark, NAMES, 40)
    exact = {r["cand"]: r["auc"] for r in EN.blend_search(df, "k", "y", NAMES, candidates=cw).collect()}
    table, weights = EN.race_table(df, "k", "y", NAMES), EN.weights_by(cw, NAMES)
    assert {r["cand"]: r["auc"] for r in EN.race_aucs(table, weights, 12).collect()} == exact
    for c, (low, high) in EN.race_bounds(table, weights, 12).items():
        assert low - 1e-12 <= exact[c] <= high + 1e-12
    monkeypatch.setattr(EN, "blended", lambda *a, **k: pytest.fail("rows are copied per candidate"))
    left = {r["cand"]: r["auc"] for r in EN.blend_race(df, "k", "y", NAMES, cw).collect()}
    best = max(exact, key=lambda c: (exact[c], -c))
    assert left == {c: exact[c] for c in left} and best in left and len(left) < 20
    wide = []
    plain = EN.race_table
    monkeypatch.setattr(EN, "race_table", lambda *a: wide.append(1) or plain(*a))
    found, auc = EN.refine(df, "k", "y", NAMES, dict(zip(NAMES, weights[best])), rounds=2, per_round=8)
    assert auc >= exact[best] and len(wide) == 1
