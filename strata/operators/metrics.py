"""Exact evaluation metrics as aggregates.

ROC-AUC is the tie-aware Mann–Whitney statistic: rows are first collapsed to
one row per distinct (group, score) — map-side partial aggregation, so a hot
score costs nothing — then the running count of negatives below each score
comes from ``ranking.prefix_in_groups``. The sum is kept in integers
(``pos * (2*neg_below + neg)``) so it is exact in any summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_in_groups


def roc_auc_counts(df: DataFrame, score: str, pos: str, neg: str, group_cols=(),
                   out: str = "auc") -> DataFrame:
    """AUC from pre-aggregated rows ``(group.., score, pos, neg)``; scores may repeat."""
    g = list(group_cols)
    per_score = df.groupBy(*g, score).agg(F.sum(pos).cast("long").alias("_pos"),
                                          F.sum(neg).cast("long").alias("_neg"))
    below = prefix_in_groups(per_score, g, [score], ["_neg"])
    return (below.groupBy(*g).agg(
                F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
                F.sum(F.col("_pos") * (2 * F.col("_neg_before") + F.col("_neg"))).alias("_u2"))
            .select(*g, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_u2") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias(out)))


def roc_auc(df: DataFrame, label: str, score: str, group_cols=(), out: str = "auc") -> DataFrame:
    """Exact tie-aware ROC-AUC per group (NULL when a group has one class). A
    null score or label is an error: dropping it would change the statistic."""
    y = F.col(label).cast("long")
    whole = F.when(F.col(score).isNull() | y.isNull(), F.raise_error(F.lit("roc_auc: null score or label")).cast("long"))
    agg = df.groupBy(*group_cols, score).agg(F.sum(F.coalesce(whole, y)).alias("_p"), F.sum(1 - y).alias("_q"))
    return roc_auc_counts(agg, score, "_p", "_q", group_cols, out)


def regression_metrics(df: DataFrame, y: str, p: str, group_cols=()) -> DataFrame:
    """MSE, R² (1 - SSE/SST), MAE and max absolute error."""
    e = F.col(y) - F.col(p)
    return (df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_abs_err")))


def accuracy(df: DataFrame, y: str, pred: str, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def cv_summary(df: DataFrame, metric: str, group_cols) -> DataFrame:
    """Mean and population std of a per-fold metric (NumPy ``std`` ddof 0)."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(metric).alias(f"{metric}_mean"),
        F.stddev_pop(metric).alias(f"{metric}_std"))
