"""Estimators on ``pyspark.ml`` (distributed fits via treeAggregate). The
boosted families with leaf penalties, and comparisons of many fits, are in
``boosting``.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


# ---- regression (M1–M6) -------------------------------------------------------

def linear(label: str = "label", features: str = "features"):
    """M1 ordinary least squares (normal equations)."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal",
                            regParam=0.0, standardization=False)


def ridge(alpha: float, n: int, sigma_y: float, label: str = "label", features: str = "features"):
    """M2 ridge with the closed-form penalty ``alpha * ||w||²`` on SSE:
    Spark's objective is SSE/(2n)·(1/σ_y) scaled, so ``regParam = alpha·σ_y/n``
    (σ_y population std for the normal solver)."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal",
                            regParam=alpha * sigma_y / n, elasticNetParam=0.0, standardization=False)


def lasso(alpha: float, label: str = "label", features: str = "features"):
    """M3 lasso: ``regParam = alpha``, L1 only, unstandardised."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=alpha,
                            elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-10)


def tree_regressor(s, label: str = "label", features: str = "features"):
    """M5 random forest (``forests.fit_cells`` fits many at once) or M6 gradient boosting with the settings of a ``boosting.Trees``."""
    if s.forest:
        # rows keep their nodes, so that tasks aren't sent the trees, and a level of all trees is one job
        return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=s.trees, maxDepth=s.depth,
                                     featureSubsetStrategy="all", cacheNodeIds=True, maxMemoryInMB=1024, seed=s.seed)
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=s.trees, stepSize=s.step, maxDepth=s.depth, seed=s.seed)


# ---- classification (M7–M12) --------------------------------------------------

def rf_classifier(n_trees: int = 100, depth: int = 10, min_leaf: int = 1, seed: int = 42,
                  weight: str | None = None, label="label", features="features"):
    """M7 random forest, sqrt feature subsets, optional balanced weights."""
    kw = dict(featuresCol=features, labelCol=label, numTrees=n_trees, maxDepth=depth,
              minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed)
    if weight:
        kw["weightCol"] = weight
    return RandomForestClassifier(**kw)


def forest(s, weight: str, label="label", features="features"):
    """M7 with the settings of a ``boosting.Trees`` and weights per row, fitted on all rows
    (``forests.fit_levels`` fits many without weights at once). MLlib has no least
    rows of a node to split; a node that splits has at least two leaves' rows, where the
    published forests ask for those of two to three."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight, numTrees=s.trees, maxDepth=s.depth,
                                  minInstancesPerNode=s.min_rows, featureSubsetStrategy=str(s.columns), maxBins=64,
                                  cacheNodeIds=True, maxMemoryInMB=1024, seed=s.seed)


def gbt_classifier(n_iter: int = 100, step: float = 0.1, depth: int = 3, subsample: float = 1.0,
                   feature_subset: str = "all", min_leaf: int = 1, min_gain: float = 0.0,
                   seed: int = 42, weight: str | None = None, label="label", features="features"):
    """M8 gradient boosting."""
    kw = dict(featuresCol=features, labelCol=label, maxIter=n_iter, stepSize=step, maxDepth=depth,
              subsamplingRate=subsample, featureSubsetStrategy=feature_subset,
              minInstancesPerNode=min_leaf, minInfoGain=min_gain, seed=seed)
    if weight:
        kw["weightCol"] = weight
    return GBTClassifier(**kw)


def logistic(C: float = 1.0, n: int | None = None, weight: str | None = None,
             label="label", features="features", tol: float = 1e-6):
    """M12 L2 logistic regression with inverse strength C on the summed loss:
    ``regParam = 1 / (C * n)`` (n = rows, or the weight total)."""
    kw = dict(featuresCol=features, labelCol=label, standardization=False, maxIter=100, tol=tol)
    if n:
        kw["regParam"] = 1.0 / (C * n)
        kw["elasticNetParam"] = 0.0
    if weight:
        kw["weightCol"] = weight
    return LogisticRegression(**kw)


def positive_probability(pred: DataFrame, prob_col: str = "probability", out: str = "p") -> DataFrame:
    """M32 score: P(class 1) as a double column."""
    return pred.withColumn(out, vector_to_array(F.col(prob_col)).getItem(1))

