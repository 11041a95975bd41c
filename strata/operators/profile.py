"""Table profiling: shape/null profile, value counts, class balance and
weights, column statistics. Each is one aggregate (map-side partial agg)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_medians
from .util import broadcast_if_small, stored


def profile(df: DataFrame) -> DataFrame:
    """One row per column: dtype, rows, non-null and null counts."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    dtypes = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{dtypes[c]}', {i}, _nn_{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column_name, dtype, position, non_null)")
    return long.select("column_name", "dtype", F.col("position").cast("int").alias("position"),
                       F.col("_n").alias("n_rows"), "non_null",
                       (F.col("_n") - F.col("non_null")).alias("null_count"))


def value_counts(df: DataFrame, c: str, normalize: bool = True) -> DataFrame:
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    total = df.count()  # scalar
    return counts.withColumn("fraction", F.col("count") / F.lit(float(total)))


def class_balance(df: DataFrame, label: str, group_cols=()) -> DataFrame:
    """n, positives, negatives, positive ratio and scale_pos_weight (n_neg/n_pos)."""
    y = F.col(label).cast("long")
    return (df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(y).alias("n_pos"), F.sum(1 - y).alias("n_neg"))
            .withColumn("pos_ratio", F.col("n_pos") / F.col("n"))
            .withColumn("scale_pos_weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos"))))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: count and the 'balanced' weight n / (n_classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(float(tot["n"])) / (F.lit(tot["k"]) * F.col("n_class")))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced class weight as a column (a ``weightCol`` for ML)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    # one row per class, broadcast when its written size allows it
    return df.join(broadcast_if_small(stored(w, "classes")), label)


def column_stats(df: DataFrame, cols) -> DataFrame:
    """min, max, mean, exact median and population std per column (long form)."""
    cols = list(cols)
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(F.col(c).cast("double")).alias(f"mn{i}"), F.max(F.col(c).cast("double")).alias(f"mx{i}"),
        F.avg(c).alias(f"av{i}"), F.stddev_pop(c).alias(f"sd{i}"), F.count(c).alias(f"n{i}"))]).first()
    med = exact_medians(df, cols)
    rows = [(c, agg[f"n{i}"], agg[f"mn{i}"], agg[f"mx{i}"], agg[f"av{i}"], med[c], agg[f"sd{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, n long, min double, max double, mean double, median double, std double")
