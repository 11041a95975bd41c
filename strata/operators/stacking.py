"""Stacks of logistic models, cross-fitted in shared passes.

Base models differ in features, penalty and weights. Split f < k of every base
model and split k (all rows) are fitted at once (``newton``), which is as many
passes over the rows as the slowest fit needs steps. A row's base predictions
come from the models that didn't see its fold: the coefficients of a split are
one row of a table with k rows, joined on the fold, so nothing is shuffled and
nothing runs in Python. The meta-models are fitted on these predictions in the
same way, each without the fold that it scores.

New rows are scored by the base models and the meta-model of split k.

Cases: rows with a null feature or label aren't fitted, and a null feature
gives a null prediction. A split without both classes gives null predictions
to the rows it would score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import newton
from .util import stored

#: Name of the meta-model and of the plain mean among the predictions.
STACK, MEAN = "stack", "mean"


def sigmoid_of(x: Column, coefs: Column, width: int) -> Column:
    """Probability of label 1; ``coefs`` has the intercept, then a number per feature."""
    return 1 / (1 + F.exp(-reduce(add, [coefs[i + 1] * x[i] for i in range(width)], coefs[0])))


@dataclass
class Stack:
    """``base``: per split the coefficients of every base model, ``meta``: per
    split those of the meta-model, as rows of numbers (intercept first)."""

    names: list[str]
    k: int
    width: int
    base: dict[int, list[list[float]]]
    meta: dict[int, list[float]]

    def base_proba(self, x: Column, coefs: Column) -> Column:
        return F.array(*[sigmoid_of(x, coefs[m], self.width) for m in range(len(self.names))])

    def predict(self, df: DataFrame, x: str = "x", out: str = "p") -> DataFrame:
        """``df`` with the stack's probability for rows that weren't fitted."""
        base = F.array(*[F.array(*map(F.lit, c)) for c in self.base[self.k]])
        got = self.base_proba(F.col(x), base)
        return df.withColumn(out, sigmoid_of(got, F.array(*map(F.lit, self.meta[self.k])), len(self.names)))


def all_splits(models: dict[str, newton.Logistic], k: int) -> dict[str, newton.Logistic]:
    return {f"{n}/{f}": replace(m, held=f if f < k else None) for n, m in models.items() for f in range(k + 1)}


def row(fitted, m: newton.Logistic, width: int) -> list:
    """(intercept, coefficients of all features); nulls without a fit."""
    if fitted is None:
        return [None] * (width + 1)
    own = [0.0] * width
    for i, b in zip(range(width) if m.columns is None else m.columns, fitted[0]):
        own[i] = float(b)
    return [fitted[1], *own]


def split_table(spark, name: str, rows: dict[int, list], kind: str, k: int) -> DataFrame:
    """(fold, coefficients): k rows, so its size is bounded."""
    return F.broadcast(spark.createDataFrame([(f, rows[f]) for f in range(k)], f"fold int, {name} {kind}"))


def cross_fit(rows: DataFrame, bases: dict[str, newton.Logistic], meta: newton.Logistic, k: int, width: int, key: str,
              label: str, x: str = "x") -> tuple[DataFrame, Stack]:
    """(out-of-fold predictions as (key, label, fold, model, p) of the base
    models, their mean and the stack; the stack). ``rows`` is a written table
    with folds 0 to k - 1 and an array of ``width`` features."""
    spark, names = rows.sparkSession, list(bases)
    fits = newton.fit(rows, all_splits(bases, k), label, x)
    stack = Stack(names, k, width, {f: [row(fits[f"{n}/{f}"], bases[n], width) for n in names] for f in range(k + 1)}, {})
    table = split_table(spark, "coefs", stack.base, "array<array<double>>", k)
    level1 = stored(rows.join(table, "fold").select(key, label, "fold", stack.base_proba(F.col(x), F.col("coefs")).alias("x")), "level1")
    top = newton.fit(level1, all_splits({STACK: meta}, k), label)
    stack.meta = {f: row(top[f"{STACK}/{f}"], meta, len(names)) for f in range(k + 1)}
    both = level1.join(split_table(spark, "coefs", stack.meta, "array<double>", k), "fold")
    p = [*[(n, F.col("x")[i]) for i, n in enumerate(names)],
         (MEAN, reduce(add, [F.col("x")[i] for i in range(len(names))]) / len(names)),
         (STACK, sigmoid_of(F.col("x"), F.col("coefs"), len(names)))]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in p])).alias("s")
    return both.select(key, label, "fold", long).select(key, label, "fold", "s.*"), stack
