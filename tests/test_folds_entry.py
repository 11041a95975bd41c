
from strata.operators.folds import kfold_contiguous, kfold_stratified


def test_stratified_fold_sizes(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = kfold_stratified(df, 5, "y", "id", 42)
    sizes = f.groupBy("y", "fold").count().collect()
    for cls in (0, 1):
        c = [r["count"] for r in sizes if r["y"] == cls]
        assert len(c) == 5 and max(c) - min(c) <= 1
    assert f.count() == 500 and f.select("id").distinct().count() == 500


def test_contiguous_folds_like_ntile(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "k long")
    got = [r["fold"] for r in kfold_contiguous(df, 5, ["k"]).orderBy("k").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) == {"fold", "n_pos", "n_neg", "auc"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_oof_covers_each_row_once(spark):
    from strata.operators import validate as V
    from strata.operators.features import FeaturePlan
    from strata.operators.util import stored
    rows = [(i, float(i % 3), float((i * 7) % 11), 1.0 if i % 4 == 0 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    df = stored(kfold_stratified(df, 4, "label", "id", 1), "rows")
    s = V.setup(df, 4, "id", "label", FeaturePlan(numeric=["a", "b"], encode={}, flags=(), spec=()))
    oof, _ = V.out_of_fold(s, {"line": V.logistic(1.0)})
    assert oof.count() == 200 and oof.select("id").distinct().count() == 200
