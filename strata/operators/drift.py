"""Train/test drift: tagged union (U1), mean-shift table (A12), drift-score
sample weights (P27/W7), adversarial validation and drift-weighted fits
(M29/M30, see ``validate``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import diff_marker
from .util import broadcast_if_small, stored


def tag_union(train: DataFrame, test: DataFrame, flag: str = "is_test") -> DataFrame:
    return (train.withColumn(flag, F.lit(0))
            .unionByName(test.withColumn(flag, F.lit(1)), allowMissingColumns=True))


def drift_table(train: DataFrame, test: DataFrame, cols, flag: str = "is_test") -> DataFrame:
    """Per column: train mean, test mean, diff % = 100·(te − tr)/(|tr| + 1e-10), marker.
    One grouped aggregate over the union (two groups) and an unpivot."""
    u = tag_union(train.select(*cols), test.select(*cols), flag)
    means = u.groupBy(flag).agg(*[F.avg(c).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = means.selectExpr(flag, f"stack({len(cols)}, {stack}) as (column_name, mean)")
    wide = long.groupBy("column_name").agg(
        F.max(F.when(F.col(flag) == 0, F.col("mean"))).alias("train_mean"),
        F.max(F.when(F.col(flag) == 1, F.col("mean"))).alias("test_mean"))
    diff = 100 * (F.col("test_mean") - F.col("train_mean")) / (F.abs(F.col("train_mean")) + 1e-10)
    return wide.withColumn("diff_pct", diff).withColumn("marker", diff_marker(F.col("diff_pct")))


def drift_weights(df: DataFrame, score: str, out: str = "weight") -> DataFrame:
    """w = p² / mean(p²). The mean is one scalar aggregate (no global
    window, no join)."""
    m = df.agg(F.avg(F.col(score) * F.col(score))).first()[0]
    return df.withColumn(out, F.col(score) * F.col(score) / F.lit(float(m)))


def frequency_drift_score(train: DataFrame, test: DataFrame, by, flag: str = "is_test",
                          out: str = "p") -> DataFrame:
    """A model-free adversarial score: P(test | by) estimated by counts over the
    union (one grouped aggregate), attached to every row of the union. The rates
    are written first: a small table is broadcast, so that a value of ``by`` that
    holds most rows stays spread; null values are a group of their own."""
    u = tag_union(train, test, flag)
    by = list(by)
    rate = stored(u.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.avg(F.col(flag).cast("double")).alias(out)), "rates")
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        on = same if on is None else on & same
    return u.join(broadcast_if_small(rate), on).drop(*[f"_by_{c}" for c in by])
