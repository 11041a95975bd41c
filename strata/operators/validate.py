"""Cross-validation, out-of-fold prediction, stacking and model reports.

``Setup`` holds a labelled table with its folds and one feature plan per fold,
fitted without the fold's rows, so that no statistic of a held-out row reaches
the model that scores it; feature selection and calibration belong to a
setting and are fitted inside as well. All fits read all rows of their split.
Forests take a pass per level for all of them (``forests``); logistic models and
weighted forests are MLlib fits, several at once from driver threads; boosted
settings are fitted all at once, one task a fit (``boosting``). All trees score a
row in one pass. The driver loops over folds and settings, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting as B
from . import forests as FO
from . import models as M
from .concurrent import at_once
from .metrics import regression_metrics, roc_auc
from ..functions.columns import ladder
from .util import stored


@dataclass
class Setup:
    """``rows``: a written table with ``key``, ``label``, a ``fold`` from 0 to k - 1
    and raw columns. Split f < k fits on the rows outside fold f and holds out
    fold f; split k fits on all rows. ``plans`` has a plan per split."""

    rows: DataFrame
    k: int
    key: str
    label: str
    plans: list
    cols: list
    test: DataFrame | None = None
    weight: str | None = None
    fold: str = "fold"

    def features(self, df: DataFrame, split: int, is_test: bool = False) -> DataFrame:
        keep = [c for c in (self.key, self.label, self.fold, self.weight, "inner") if c and c in df.columns]
        got = self.plans[split].transform(df, is_test=is_test)
        return got.select(*keep, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols]).alias("x"))

    def fit_rows(self, split: int) -> DataFrame:
        return self.features(self.rows.where(F.col(self.fold) != split), split)

    def held_rows(self, split: int) -> DataFrame:
        return self.features(self.rows.where(F.col(self.fold) == split), split)

    def test_rows(self, split: int) -> DataFrame:
        return self.features(self.test, split, is_test=True)


def setup(rows: DataFrame, k: int, key: str, label: str, plan, test: DataFrame | None = None,
          weight: str | None = None) -> Setup:
    """Fit ``plan`` for every split of ``rows`` (a written table with ``fold``)."""
    plans = plan.fit_folds(rows, k)
    return Setup(rows, k, key, label, plans, plan.output_columns, test, weight)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector("x"))


class Fitted:
    """Models by (name, split) that add a probability column to a feature frame:
    ``trees`` of ``boosting``, and ``mllib`` those of MLlib or grown as there (forests are in both)."""

    def __init__(self, trees: dict, mllib: dict):
        self.trees, self.mllib = trees, mllib

    def names(self) -> list[str]:
        return list(dict.fromkeys(n for n, _ in [*self.trees, *self.mllib]))

    def score(self, df: DataFrame, name: str, split: int, out: str = "p") -> DataFrame:
        if (name, split) in self.trees:
            return df.withColumn(out, B.score(F.col("x"), self.trees[name, split]))
        got = self.mllib[name, split].transform(vectors(df))
        return M.positive_probability(got, out=out).select(*df.columns, out)

    def score_all(self, parts: list[tuple[int, DataFrame]]) -> DataFrame:
        """The rows of every (split, frame) by all models of the split: the frame's columns
        without ``x``, then split, model and p. Trees score a row in one pass."""
        trees = [n for n in self.names() if any(a == n for a, _ in self.trees)]
        got = [B.score_many(parts, self.trees, trees)] if trees else []
        for n in self.names():
            if n not in trees:
                got += [self.score(df, n, f).withColumn("split", F.lit(f)).withColumn("model", F.lit(n)).drop("x") for f, df in parts]
        return union(got)


def fit(s: Setup, settings: dict[str, B.Trees | Callable], splits, weight: str | None = None,
        frames: dict[int, DataFrame] | None = None) -> Fitted:
    """Fit every setting on every split. A setting is ``Trees`` or a function
    that makes an MLlib classifier for the fitted rows."""
    frames = frames or {f: s.fit_rows(f) for f in splits}
    boosted = {n: t for n, t in settings.items() if isinstance(t, B.Trees) and not t.forest}
    models = B.fit_many(frames, boosted, s.key, s.label, weight=weight) if boosted else {}
    wooded = {n: t for n, t in settings.items() if isinstance(t, B.Trees) and t.forest and not weight}
    forests = FO.fit_levels(frames, wooded, s.key, s.label) if wooded else {}
    models |= forests
    rest = {n: make for n, make in settings.items() if n not in boosted and n not in wooded}
    if not rest:
        return Fitted(models, forests)
    # written once, as every fit and every level of a forest's trees reads them, in partitions of a
    # size that pays: with 8 of a few hundred rows each, five forests took 23 s
    ready = {f: stored(df.withColumn("label", F.col(s.label).cast("double")).hint("rebalance"), "fit") for f, df in frames.items()}

    def one(make, rows: DataFrame) -> Callable:
        def run():
            if not isinstance(make, B.Trees):
                return make(rows).fit(vectors(rows))
            own = F.col(weight).cast("double") if weight else F.lit(1.0)
            weighed = balanced_weight(rows, s.label, "_class") if make.balanced else rows.withColumn("_class", F.lit(1.0))
            return M.forest(make, "_w").fit(vectors(weighed.withColumn("_w", own * F.col("_class"))))
        return run
    at = {f"{n}/{f}": (n, f) for n in rest for f in ready}
    got = at_once(s.rows.sparkSession, {name: one(rest[n], ready[f]) for name, (n, f) in at.items()})
    return Fitted(models, forests | {at[name]: model for name, model in got.items()})


def out_of_fold(s: Setup, settings: dict, weight: str | None = None, in_sample: bool = False):
    """(out-of-fold predictions of every row by the models that did not see
    it, as (key, label, fold, model, p); the models). With ``in_sample`` the rows
    a model was fitted on are scored as well, marked by ``seen``. Written once."""
    models = fit(s, settings, range(s.k), weight)
    held = [(f, s.features(s.rows if in_sample else s.rows.where(F.col(s.fold) == f), f)) for f in range(s.k)]
    scored = models.score_all(held)
    return stored(scored.select(s.key, s.label, F.col("split").alias("fold"), "model", "p",
                                *([(F.col(s.fold) != F.col("split")).alias("seen")] if in_sample else [])), "oof"), models


def test_scores(s: Setup, models: Fitted) -> DataFrame:
    """Fold-averaged predictions of the test rows, as (key, model, p)."""
    return models.score_all([(f, s.test_rows(f)) for f in range(s.k)]).groupBy(s.key, "model").agg(F.avg("p").alias("p"))


def cv_report(s: Setup, settings: dict, weight: str | None = None) -> DataFrame:
    """Per model the mean training AUC, mean and standard deviation of
    the validation AUC over the folds."""
    both, _ = out_of_fold(s, settings, weight, in_sample=True)
    auc = stored(roc_auc(both, s.label, "p", ["model", "fold", "seen"]), "auc")
    return auc.groupBy("model").agg(
        F.avg(F.when(F.col("seen"), F.col("auc"))).alias("train_auc"),
        F.avg(F.when(~F.col("seen"), F.col("auc"))).alias("cv_auc"),
        F.stddev_pop(F.when(~F.col("seen"), F.col("auc"))).alias("cv_std"))


def logistic(c: float) -> Callable:
    """An MLlib logistic regression of inverse strength ``c``; the penalty is
    divided by the rows of the very fit."""
    return lambda rows: M.logistic(C=c, n=rows.count())


def balanced_weight(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 n_class) per row, from one aggregate of the rows themselves."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).first()
    pos, neg = max(t["pos"] or 0, 1), max((t["n"] or 0) - (t["pos"] or 0), 1)
    return rows.withColumn(out, F.when(F.col(label) == 1, F.lit(t["n"] / (2.0 * pos))).otherwise(F.lit(t["n"] / (2.0 * neg))))


def wide(preds: DataFrame, key: str, names: list[str], *keep: str) -> DataFrame:
    """One row per key with the models' probabilities as an array ``x``."""
    cols = [F.max(F.when(F.col("model") == n, F.col("p"))).alias(f"_m{i}") for i, n in enumerate(names)]
    got = preds.groupBy(key, *keep).agg(*cols)
    return got.select(key, *keep, F.array(*[f"_m{i}" for i in range(len(names))]).alias("x"))


def meta_logistic(rows: DataFrame, label: str, c: float, balanced: bool):
    """The logistic meta-model over ``x``; balanced weights sum to the rows."""
    rows = rows.withColumn("label", F.col(label).cast("double"))
    n = rows.count()
    if balanced:
        return M.logistic(C=c, n=n, weight="weight").fit(vectors(balanced_weight(rows, label)))
    return M.logistic(C=c, n=n).fit(vectors(rows))


def stack(s: Setup, settings: dict, c: float, inner: int = 5):
    """Base models stacked under a balanced logistic meta-model.

    For every split the meta-model is fitted on out-of-fold predictions within
    the split's fitted rows (an independent ``inner`` fold column), and applied
    to the base models refitted on all of them. Returns the held-out
    predictions of the stack and of the base models, and the test scores."""
    splits = range(s.k + 1)
    names = list(settings)
    frames = {}
    for f in splits:
        rows = s.fit_rows(f)
        frames[f * (inner + 1) + inner] = rows
        for j in range(inner):
            frames[f * (inner + 1) + j] = rows.where(F.col("inner") != j)
    models = fit(s, settings, (), frames=frames)
    parts, test = [], None
    for f in splits:
        own = f * (inner + 1)
        rows = s.fit_rows(f)
        level1 = models.score_all([(own + j, rows.where(F.col("inner") == j)) for j in range(inner)])
        meta = meta_logistic(stored(wide(level1, s.key, names, s.label), "level1"), s.label, c, True)
        if f < s.k:
            base = stored(models.score_all([(own + inner, s.held_rows(f))]).select(
                s.key, s.label, F.lit(f).alias("fold"), "model", "p"), "base")
            top = M.positive_probability(meta.transform(vectors(wide(base, s.key, names, s.label, "fold"))), out="p")
            parts += [base, top.select(s.key, s.label, "fold", F.lit("stack").alias("model"), "p")]
        elif s.test is not None:
            base = models.score_all([(own + inner, s.test_rows(f))]).select(s.key, "model", "p")
            top = M.positive_probability(meta.transform(vectors(wide(base, s.key, names))), out="p")
            test = top.select(s.key, F.lit("stack").alias("model"), "p")
    return stored(union(parts), "stacked"), test


def cross_validate(make_estimator: Callable, df: DataFrame, k: int, label: str = "label", fold_col: str = "fold") -> DataFrame:
    """M13 for MLlib regressors on a frame with ``features`` and folds: per fold
    MSE and R² of the held-out and of the fitted rows."""
    df = stored(df, "folds")
    rows = []
    for f in range(k):
        tr, va = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        model = make_estimator().fit(tr)
        both = model.transform(df).withColumn("seen", F.col(fold_col) != f)
        got = {r["seen"]: r for r in regression_metrics(both, label, "prediction", ["seen"]).collect()}
        rows.append((f, got[True]["mse"], got[True]["r2"], got[False]["mse"], got[False]["r2"]))
    return df.sparkSession.createDataFrame(
        rows, "fold int, train_mse double, train_r2 double, valid_mse double, valid_r2 double")


# fixed values: fit-diagnosis thresholds of the regression study
def fit_diagnosis(train_r2: Column, cv_r2: Column, relative_gap: Column) -> Column:
    """P21 overfit/underfit verdict (Column expressions)."""
    return (F.when((train_r2 > 0.9) & (cv_r2 < 0.7), F.lit("high_overfit"))
            .when((train_r2 < 0.5) & (cv_r2 < 0.5), F.lit("underfit"))
            .when(relative_gap < 10, F.lit("good"))
            .otherwise(F.lit("moderate_overfit")))


def quality_band(cv_r2: Column) -> Column:
    return ladder(cv_r2, [(0.3, "poor"), (0.6, "moderate")], default="good")


def feature_importance(model, features) -> list[tuple[str, float]]:
    """M26 importances as (name, value) — a list of at most #features rows."""
    if isinstance(model, dict):
        total = sum(model["importance"]) or 1.0
        return [(f, v / total) for f, v in zip(features, model["importance"])]
    imp = model.featureImportances
    vals = imp.toArray() if not isinstance(imp, DenseVector) else imp.values
    return [(f, float(v)) for f, v in zip(features, vals)]
