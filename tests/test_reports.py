import pytest
from pyspark.sql import functions as F

from strata.operators import reports as RP
from strata.operators.drift import drift_table
from strata.operators.profile import class_balance, profile, with_class_weight

# fixed values: the three published version records (train AUC, CV AUC, gap, test points)
VERSIONS = [("v3", 1.0000, 0.8677, 84), ("v4", 0.9668, 0.8692, 74), ("v5", 0.9866, 0.8809, None)]


def test_version_and_gap_report(spark):
    df = spark.createDataFrame(VERSIONS, "version string, train_auc double, cv_auc double, test_points int")
    r = {x["version"]: x for x in RP.version_report(RP.gap_report(df)).collect()}
    assert (r["v3"]["gap_band"], r["v3"]["verdict"], r["v3"]["gap_flag"]) == ("problem", "overfit", "high")
    assert (r["v4"]["gap_band"], r["v4"]["verdict"], r["v4"]["gap_flag"]) == ("good", "excellent", "ok")
    assert (r["v5"]["gap_band"], r["v5"]["verdict"], r["v5"]["gap_flag"]) == ("acceptable", "acceptable", "ok")
    assert r["v3"]["expected_points"] == pytest.approx(84.625)
    assert r["v4"]["points_diff"] == pytest.approx(74 - 86.5)
    assert r["v5"]["expected_points"] == pytest.approx(100.0) and r["v5"]["points_diff"] is None
    t = RP.thresholds_table(spark, RP.GAP_BANDS, RP.GAP_BAND_TOP)
    j = {x["version"]: x["status"] for x in RP.range_lookup(RP.gap_report(df), "gap", t).collect()}
    assert j == {k: r[k]["gap_band"] for k in r}


def test_diff_marker_larger_bound_first(spark):
    df = spark.createDataFrame([(10.0,), (-30.0,), (75.0,)], "d double")
    assert [x[0] for x in df.select(RP.diff_marker(F.col("d"))).collect()] == ["ok", "warning", "severe"]


def test_profile_balance_weights_drift(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 3.0, 0), (3, 5.0, 0), (4, 1.0, 0)], "k int, e double, y int")
    p = {x["column_name"]: x for x in profile(df).collect()}
    assert p["e"]["null_count"] == 1 and p["k"]["non_null"] == 4 and p["e"]["n_rows"] == 4
    b = class_balance(df, "y").first()
    assert (b["n_pos"], b["n_neg"], b["scale_pos_weight"]) == (1, 3, 3.0)
    w = {x["y"]: x["weight"] for x in with_class_weight(df, "y").select("y", "weight").distinct().collect()}
    assert w == {1: 2.0, 0: pytest.approx(4 / 6)}
    tr = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    te = spark.createDataFrame([(3.0,), (5.0,)], "a double")
    d = drift_table(tr, te, ["a"]).first()
    assert (d["train_mean"], d["test_mean"], d["marker"]) == (2.0, 4.0, "severe")
    assert d["diff_pct"] == pytest.approx(100.0)
