"""Deterministic fold assignment (contiguous, shuffled, stratified).

Shuffling is an md5 order of ``seed:key`` so that Spark and SQL agree row for
row; ranks come from ``ranking``, never from a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank, rank_in_groups


def shuffle_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def ntile_index(rank: Column, n: int, k: int) -> Column:
    """0-based ``ntile(k)`` from a 1-based rank among ``n`` rows: the first
    ``n % k`` tiles hold one extra row (same rule as unshuffled KFold)."""
    q, r = divmod(n, k)
    i = rank - 1
    big = r * (q + 1)
    if q == 0:
        return i.cast("int")
    return F.when(i < F.lit(big), F.floor(i / F.lit(q + 1))) \
            .otherwise(F.lit(r) + F.floor((i - F.lit(big)) / F.lit(q))).cast("int")


def kfold_contiguous(df: DataFrame, k: int, order_cols, fold_col: str = "fold") -> DataFrame:
    """Contiguous folds in ``order_cols`` order (unique key)."""
    n = df.count()  # one scalar, needed for the tile sizes
    ranked = global_rank(df, order_cols, "_kf_rank")
    return ranked.withColumn(fold_col, ntile_index(F.col("_kf_rank"), n, k)).drop("_kf_rank")


def kfold_shuffled(df: DataFrame, k: int, key: str, seed: int = 42,
                   fold_col: str = "fold") -> DataFrame:
    h = df.withColumn("_kf_h", shuffle_key(key, seed))
    ranked = global_rank(h, ["_kf_h", key], "_kf_rank")
    return ranked.withColumn(fold_col, ((F.col("_kf_rank") - 1) % k).cast("int")).drop("_kf_h", "_kf_rank")


def kfold_stratified(df: DataFrame, k: int, label: str, key: str, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Per-class round robin over the md5 order: within every class the fold
    sizes differ by at most one."""
    h = df.withColumn("_kf_h", shuffle_key(key, seed))
    ranked = rank_in_groups(h, [label], ["_kf_h", key], "_kf_rank")
    return ranked.withColumn(fold_col, ((F.col("_kf_rank") - 1) % k).cast("int")).drop("_kf_h", "_kf_rank")

