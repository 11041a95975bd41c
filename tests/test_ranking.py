import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import ranking as RK


def _data(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if rng.random() < 0.4 else rng.randint(1, 6)      # a hot group
        rows.append((i, g, rng.randint(0, 50), rng.random()))
    return spark.createDataFrame(rows, "id long, g int, k int, v double")


def _nulls(df):
    """Some null groups and null order keys."""
    return df.withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g"))).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("k")))


def test_global_rank_matches_window(spark):
    df = _nulls(_data(spark))
    a = RK.global_rank(df, ["k", "id"], "r").select("id", "r").toPandas()
    b = df.withColumn("r", F.row_number().over(Window.orderBy("k", "id"))).select("id", "r").toPandas()
    assert len(a) == len(b) and dict(zip(a.id, a.r)) == dict(zip(b.id, b.r))


def test_rank_in_groups(spark):
    df = _nulls(_data(spark))
    exp = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k", "id"))).toPandas()
    got = RK.rank_in_groups(df, ["g"], ["k", "id"], "r").toPandas()
    assert len(got) == len(exp) and dict(zip(got.id, got.r)) == dict(zip(exp.id, exp.r))


def test_duplicate_rows_get_distinct_ranks(spark):
    df = spark.createDataFrame([(1, 5)] * 40 + [(None, 5)] * 10, "g int, k int")
    got = RK.rank_in_groups(df, ["g"], ["k"], "r").toPandas()
    assert sorted(got[got.g == 1].r) == list(range(1, 41)) and sorted(got[got.g.isna()].r) == list(range(1, 11))


def test_prefix_sum_grouped(spark):
    df = _nulls(_data(spark)).withColumn("x", (F.col("k") % 7).cast("long"))
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.withColumn("x_before", F.coalesce(F.sum("x").over(w), F.lit(0))).toPandas()
    got = RK.prefix_in_groups(df, ["g"], ["k", "id"], ["x"]).toPandas()
    assert len(got) == len(exp) and dict(zip(got.id, got.x_before)) == dict(zip(exp.id, exp.x_before))
    whole = RK.prefix_in_groups(df.where("id < 500"), [], ["id"], ["x"], rank_col="r").toPandas().sort_values("id")
    assert whole.r.tolist() == list(range(1, 501)) and whole.x_before.iloc[0] == 0


def test_forward_fill(spark):
    rng = random.Random(3)
    rows = [(i, i % 3 or None, (i * 7) % 1000, (f"m{i}" if rng.random() < 0.1 else None)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g int, pos int, m string")
    got = RK.forward_fill(df, ["g"], ["pos", "id"], ["m"]).toPandas()
    exp = {}
    for g in (None, 1, 2):
        last = None
        for r in sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0])):
            last = r[3] if r[3] is not None else last
            exp[r[0]] = last
    assert len(got) == 2000 and {k: v if isinstance(v, str) else None for k, v in zip(got.id, got.m)} == exp


def test_no_task_gets_a_whole_hot_group(spark):
    """The plan has no window without a partition over the rows."""
    df = RK.rank_in_groups(_data(spark), ["g"], ["k", "id"], "r")
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
