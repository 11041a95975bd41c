"""Blending, voting, weight search and calibration over LONG prediction
tables ``(key, model, p)`` — one row per (row, model), so any number of
models is just more rows and every blend is a grouped aggregate.
"""

from __future__ import annotations

import sys
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .concurrent import at_once
from .metrics import roc_auc_counts
from .util import broadcast_if_small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only


def hard_vote(preds: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Majority of per-model classes, ``bround(mean(class))`` (half-even)."""
    cls = (F.col("p") > F.lit(threshold)).cast("double")
    return preds.groupBy(key).agg(F.bround(F.avg(cls), 0).cast("int").alias("vote"))


def weighted_blend(preds: DataFrame, weights: DataFrame, key: str, out: str = "p") -> DataFrame:
    """Σ w·p / Σ w per row; ``weights (model, w)`` has one row per model and
    is broadcast when its written size allows it."""
    j = preds.join(broadcast_if_small(stored(weights, "weights")), "model")
    return j.groupBy(key).agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias(out))


def mean_blend(preds: DataFrame, key: str, exclude=(), out: str = "p") -> DataFrame:
    """M22 (+P26): plain mean of the model probabilities, optionally without some models."""
    p = preds.where(~F.col("model").isin(list(exclude))) if exclude else preds
    return p.groupBy(key).agg(F.avg("p").alias(out))


def candidate_weights(spark, models, n_candidates: int, seed: int = 42, start: int = 0) -> DataFrame:
    """md5-derived uniform weights in [0,1) per (candidate, model); the same
    rule is used by the SQL oracle. ``(cand, model, w)``."""
    c = spark.range(start, start + n_candidates).withColumnRenamed("id", "cand")
    cm = c.select("cand", F.explode(F.array(*[F.lit(x) for x in models])).alias("model"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cand").cast("string"),
                                             F.col("model"))), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return cm.select("cand", "model", u.alias("w"))


def blended(oof: DataFrame, key: str, label: str, models, candidates: DataFrame, digits: int) -> DataFrame:
    """(cand, score, y): every candidate's normalised blend of every row, made
    where the rows lie. Predictions are pivoted to one row per key; candidates
    are a literal, as they are a parameter of the search and not data. One whose
    weights sum to 0 has no rows."""
    by = {}
    for r in candidates.collect():
        by.setdefault(r["cand"], {})[r["model"]] = r["w"]
    listed = F.array(*[F.struct(F.lit(c).cast("long").alias("cand"), *[F.lit(float(w[m])).alias(f"w{i}") for i, m in enumerate(models)])
                       for c, w in sorted(by.items()) if sum(w.values()) > 0])
    wide = oof.groupBy(key, label).agg(*[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"_m{i}")
                                         for i, m in enumerate(models)])
    each = wide.select(label, *[f"_m{i}" for i in range(len(models))], F.explode(listed).alias("c"))
    dot, total = F.lit(0.0), F.lit(0.0)
    for i in range(len(models)):
        dot, total = dot + F.col(f"c.w{i}") * F.col(f"_m{i}"), total + F.col(f"c.w{i}")
    return each.select(F.col("c.cand").alias("cand"), F.round(dot / total, digits).alias("score"), F.col(label).cast("long").alias("y"))


def auc_of(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("cand", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return roc_auc_counts(counts, "score", "pos", "neg", ["cand"]).select("cand", "auc")


def blend_search(oof: DataFrame, key: str, label: str, models, n_candidates: int = 200,
                 seed: int = 42, digits: int = 12, candidates: DataFrame | None = None) -> DataFrame:
    """The exact OOF AUC of every candidate weight vector (``n_candidates``
    drawn ones, or those given). A candidate whose weights sum to 0 scores 0."""
    cw = candidates if candidates is not None else candidate_weights(oof.sparkSession, models, n_candidates, seed)
    auc = auc_of(blended(oof, key, label, models, cw, digits))
    return cw.select("cand").distinct().join(auc, "cand", "left").select("cand", F.coalesce("auc", F.lit(0.0)).alias("auc"))


#: Classes of scores in a rank histogram.
CLASSES = 1024


def auc_bounds(scored: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(cand, low, high): proven bounds of each candidate's AUC from counts per
    class of scores. Pairs of rows in different classes are decided; those in
    one class may all be right or all be wrong. Counts merge before the shuffle,
    which gets at most a row per candidate, class and task."""
    kind = F.floor(F.col("score") * classes).cast("long").alias("class")
    counts = scored.groupBy("cand", kind).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    before = Window.partitionBy("cand").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per class
    run = counts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    sums = run.groupBy("cand").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * F.col("below")).alias("sure"),
                                   F.sum(F.col("pos") * F.col("neg")).alias("open"))
    pairs = F.col("p") * F.col("n")
    return sums.where(pairs > 0).select("cand", (F.col("sure") / pairs).alias("low"), ((F.col("sure") + F.col("open")) / pairs).alias("high"))


#: Steps of a class within a power of two, and the least power that has classes of its own.
STEPS, OCTAVES = 64, 42


def rounds(x, digits: int):
    """``F.round`` of doubles: half up in the shortest decimal form."""
    import numpy as np
    from decimal import ROUND_HALF_UP, Decimal
    scaled = x * 10.0 ** digits
    out = np.rint(scaled) / 10.0 ** digits
    near = np.abs(scaled - np.floor(scaled) - 0.5) <= np.maximum(1e-3, 4 * np.spacing(np.abs(scaled)))
    for i in np.flatnonzero(near):  # one in five hundred
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def classes_of(score):
    """A class that grows with the score: even steps within each power of two of the distance to 0 or to 1, where
    the scores of good models crowd."""
    import numpy as np
    low = score < 0.5
    near = np.clip(np.where(low, score, 1 - score), 2.0 ** -OCTAVES, 0.5)
    way = (near.view(np.int64) >> 46) - (np.array(2.0 ** -OCTAVES).view(np.int64) >> 46)
    return np.where(low, way, 2 * STEPS * OCTAVES - way)


def race_table(oof: DataFrame, key: str, label: str, models) -> DataFrame:
    """(y, p0, p1, ..): a row per key and label with the prediction of each model, written."""
    wide = oof.groupBy(key, label).agg(*[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p{i}") for i, m in enumerate(models)])
    return stored(wide.select(F.col(label).cast("long").alias("y"), *[f"p{i}" for i in range(len(models))]), "race")


def race_scores(batch, weights: dict[int, list[float]], digits: int):
    """Per candidate, its number and its blends of a batch of ``race_table``: those of label 1 and those of label 0.
    A null blend is below all others, NaN above; a row without a label counts in neither."""
    import numpy as np
    y = batch.column(0)
    known = np.flatnonzero(y.is_valid().to_numpy(zero_copy_only=False))
    y = np.asarray(y.to_numpy(zero_copy_only=False), dtype=float)[known] > 0
    p = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float)[known] for i in range(1, batch.num_columns)]
    null = np.any([~batch.column(i).is_valid().to_numpy(zero_copy_only=False)[known] for i in range(1, batch.num_columns)], axis=0)
    for cand, w in weights.items():
        dot, total = np.zeros(len(known)), 0.0
        for v, one in zip(w, p):
            dot, total = dot + v * one, total + v
        score = rounds(dot / total, digits)
        score = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))
        yield cand, score[y], score[~y]


def weights_by(candidates: DataFrame, models) -> dict[int, list[float]]:
    """Weights of the candidates that have any, by number."""
    by = {}
    for r in candidates.collect():
        by.setdefault(r["cand"], {})[r["model"]] = float(r["w"])
    return {c: [w[m] for m in models] for c, w in sorted(by.items()) if sum(w.values()) > 0}


def race_bounds(table: DataFrame, weights: dict[int, list[float]], digits: int) -> dict[int, tuple[float, float]]:
    """(low, high) of each candidate's AUC, as ``auc_bounds``, by finer classes: a task counts its rows by
    candidate, class and label, a shuffle adds the counts up. Without both labels a candidate has none."""
    size = 2 * STEPS * OCTAVES + 1

    def count(batches):
        import numpy as np
        sums = {c: np.zeros(2 * size, dtype=np.int64) for c in weights}
        for batch in batches:
            for c, pos, neg in race_scores(batch, weights, digits):
                sums[c] += np.bincount(np.concatenate([classes_of(pos), size + classes_of(neg)]), minlength=2 * size)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype(np.int32).tobytes() for v in sums.values()], pa.binary())],
                                         names=["cand", "n"])

    def bound(got: pa.Table) -> pa.Table:
        import numpy as np
        pos, neg = sum(np.frombuffer(v.as_buffer(), dtype=np.int32).astype(np.int64) for v in got.column("n")).reshape(2, -1)
        sure, open_, pairs = float((pos * (neg.cumsum() - neg)).sum()), float((pos * neg).sum()), float(pos.sum()) * float(neg.sum())
        some = [got.column("cand")[0].as_py()] if pairs else []
        return pa.table({"cand": pa.array(some, pa.int64()), "low": [sure / pairs for _ in some], "high": [(sure + open_) / pairs for _ in some]},
                        schema=pa.schema([("cand", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]))
    got = table.mapInArrow(count, "cand long, n binary").groupBy("cand").applyInArrow(bound, "cand long, low double, high double")
    return {r["cand"]: (r["low"], r["high"]) for r in got.collect()}


def race_aucs(table: DataFrame, weights: dict[int, list[float]], digits: int) -> DataFrame:
    """(cand, auc), exactly: a candidate's scores, nine bytes a row at most, are sorted in a task."""
    def split(batches):
        for batch in batches:
            got = list(race_scores(batch, weights, digits))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in got], pa.int64()), pa.array([p.tobytes() for _, p, _ in got], pa.binary()),
                                              pa.array([n.tobytes() for *_, n in got], pa.binary())], names=["cand", "pos", "neg"])

    def auc(got: pa.Table) -> pa.Table:
        import numpy as np
        pos, neg = (np.sort(np.frombuffer(b"".join(v.as_buffer() for v in got.column(c)))) for c in ("pos", "neg"))
        u2 = int(np.searchsorted(neg, pos, side="left").sum()) + int(np.searchsorted(neg, pos, side="right").sum())
        value = u2 / (2.0 * len(pos) * len(neg)) if len(pos) and len(neg) else None
        return pa.table({"cand": pa.array([got.column("cand")[0].as_py()], pa.int64()), "auc": pa.array([value], pa.float64())})
    return table.mapInArrow(split, "cand long, pos binary, neg binary").groupBy("cand").applyInArrow(auc, "cand long, auc double")


def blend_race(oof: DataFrame, key: str, label: str, models, candidates: DataFrame, digits: int = 12, table: DataFrame | None = None) -> DataFrame:
    """(cand, auc) of the candidates that can be the best: those whose upper
    bound is below another's lower bound are dropped, and only the others' AUCs
    are made exactly. The best of ``blend_search`` is the best here. ``table``:
    the ``race_table`` of ``oof``, if several races read it."""
    table = race_table(oof, key, label, models) if table is None else table
    weights = weights_by(candidates, models)
    bounds = race_bounds(table, weights, digits) if weights else {}
    if not bounds:
        return candidates.select("cand").distinct().withColumn("auc", F.lit(0.0))
    least = max(low for low, _ in bounds.values())
    return race_aucs(table, {c: weights[c] for c, (_, high) in bounds.items() if high >= least}, digits)


def refine(oof: DataFrame, key: str, label: str, models, best: dict[str, float], rounds: int = 3, per_round: int = 50,
           seed: int = 42, table: DataFrame | None = None) -> tuple[dict[str, float], float]:
    """Rounds of candidates around the best weights so far, each narrower than
    the last; the weights and AUC at the end, never worse than at the start."""
    import random
    rng, spark, auc, width = random.Random(seed), oof.sparkSession, None, 0.25
    table = race_table(oof, key, label, models) if table is None else table
    for _ in range(rounds):
        tries = [best] + [{m: min(max(best[m] + rng.uniform(-width, width), 0.0), 1.0) for m in models}
                          for _ in range(per_round - 1)]
        rows = [(i, m, float(t[m])) for i, t in enumerate(tries) for m in models]
        got = blend_race(oof, key, label, models, spark.createDataFrame(rows, "cand long, model string, w double"), table=table)
        top = best_candidate(got).first()
        best, auc, width = tries[top["cand"]], top["auc"], width / 2
    return best, auc


def best_candidate(scores: DataFrame) -> DataFrame:
    """Highest AUC, ties → lowest candidate id."""
    return scores.agg(F.max_by("cand", F.struct(F.col("auc"), -F.col("cand"))).alias("cand"),
                      F.max("auc").alias("auc"))


def isotonic_fit(df: DataFrame, score: str, label: str, weight: str | None = None):
    """Increasing isotonic calibration (distributed PAVA in pyspark.ml)."""
    a = VectorAssembler(inputCols=[score], outputCol="_iso_f").transform(df)
    kw = dict(featuresCol="_iso_f", labelCol=label, isotonic=True)
    if weight:
        kw["weightCol"] = weight
    return IsotonicRegression(**kw).fit(a)


def isotonic_apply(model, df: DataFrame, score: str, out: str = "p_cal") -> DataFrame:
    a = VectorAssembler(inputCols=[score], outputCol="_iso_f").transform(df)
    return model.setFeaturesCol("_iso_f").setPredictionCol(out).transform(a).drop("_iso_f")


def platt_fit(df: DataFrame, score: str, label: str):
    """Sigmoid calibration — a 1-feature logistic regression on the score
    with smoothed targets t+ = (n+ + 1)/(n+ + 2), t- = 1/(n- + 2), expressed as
    two weighted rows per input row (label 1 with weight t, label 0 with 1 − t)."""
    bal = df.agg(F.sum(F.col(label)).alias("np"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n_neg = bal["np"], bal["n"] - bal["np"]
    t_pos, t_neg = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
    t = F.when(F.col(label) == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    two = (df.select(score, t.alias("_t"))
             .select(score, F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")),
                                              F.struct(F.lit(0.0).alias("y"), (1 - F.col("_t")).alias("w")))).alias("r"))
             .select(score, F.col("r.y").alias("_y"), F.col("r.w").alias("_w")))
    a = VectorAssembler(inputCols=[score], outputCol="_pl_f").transform(two)
    return LogisticRegression(featuresCol="_pl_f", labelCol="_y", weightCol="_w", regParam=0.0,
                              standardization=False, maxIter=1000, tol=1e-14).fit(a)


def platt_apply(model, df: DataFrame, score: str, out: str = "p_cal") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    a = VectorAssembler(inputCols=[score], outputCol="_pl_f").transform(df)
    r = model.setFeaturesCol("_pl_f").transform(a)
    return r.withColumn(out, vector_to_array("probability")[1]).drop("_pl_f", "rawPrediction", "probability",
                                                                     "prediction")


#: The calibrations: how each is fitted and applied.
CALIBRATIONS = {"isotonic": (isotonic_fit, isotonic_apply), "sigmoid": (platt_fit, platt_apply)}


def cross_calibrated(scores: DataFrame, label: str, k: int, score: str = "p", fold: str = "fold") -> DataFrame:
    """The rows of ``scores`` (a written table with folds 0 to k - 1) once for each
    ``kind``: "raw", and every calibration fitted on the rows of the other folds. All
    fits run at once from driver threads. A fold whose others have one class isn't supported
    by the sigmoid curve. Empty input gives an empty result."""
    if scores.isEmpty():
        return scores.withColumn("kind", F.lit(None).cast("string"))
    fits = at_once(scores.sparkSession, {f"{kind}/{f}": partial(make, scores.where(F.col(fold) != f), score, label)
                                         for kind, (make, _) in CALIBRATIONS.items() for f in range(k)})
    out = scores.withColumn("kind", F.lit("raw"))
    for kind, (_, apply) in CALIBRATIONS.items():
        for f in range(k):
            own = apply(fits[f"{kind}/{f}"], scores.where(F.col(fold) == f), score, "_calibrated")
            out = out.unionByName(own.withColumn(score, F.col("_calibrated")).drop("_calibrated").withColumn("kind", F.lit(kind)))
    return out
