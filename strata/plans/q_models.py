"""Model queries.

Features are fitted inside the folds, settings are the published ones in full
(``boosting.PRESETS``), and boosted models (``boosting``) and forests (``forests``)
are fitted on all rows. Fitted trees have no SQL form; tests compare them with plain versions, and the reports have
fixed shapes. Stacks and calibrations with an SQL twin are in ``q_stacking``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import prob_to_class
from ..operators import boosting as B
from ..operators import models as M
from ..operators import newton
from ..operators import reports as RP
from ..operators import validate as V
from ..operators.drift import drift_weights, tag_union
from ..operators.features import V5_22, FeaturePlan
from ..operators.folds import kfold_stratified
from ..operators.knn import nearest
from ..operators.resample import oversample, synthetic
from ..operators.metrics import accuracy, cv_summary, regression_metrics, roc_auc
from ..operators.search import Range, searching
from ..operators.util import stored
from ..sources.tables import Tables
from . import docs
from . import regression as R
from .q_core import docs_folds
from .q_features import RAW_NUM
from .registry import query, rounded

K = 5

#: The five models whose out-of-fold predictions are blended and stacked.
FIVE = {"lgb": B.PRESETS["lgb_weights"], "xgb": B.PRESETS["xgb_v5"], "cb": B.PRESETS["catboost_v5"],
        "rf": B.PRESETS["rf_weights"], "gb": B.PRESETS["gb_weights"]}
#: The base models of the one-level stack.
FOUR = {n: B.PRESETS[n] for n in ("xgb_v5", "lgb_v5", "catboost_v5", "rf_v5")}


def clf_setup(spark, sf, spec=V5_22, inner=False) -> V.Setup:
    """Labelled documents in five stratified folds, plans fitted per fold."""
    train, test = docs.tables(Tables(spark, sf))
    rows = kfold_stratified(train, K, "target", "doc_id", 42)
    if inner:
        rows = kfold_stratified(rows, K, "target", "doc_id", 43, fold_col="inner")
    return V.setup(stored(rows, "labelled"), K, "doc_id", "target", FeaturePlan(numeric=RAW_NUM, spec=spec), stored(test, "test"))


def final(s: V.Setup, settings: dict) -> V.Fitted:
    """The models fitted on all labelled rows (split K)."""
    return V.fit(s, settings, [s.k])


@query("rf_clf")
def rf_clf(spark, sf):
    """M7 + M13 + P24: balanced random forest, per-fold train/valid AUC."""
    s = clf_setup(spark, sf)
    both, _ = V.out_of_fold(s, {"rf": B.PRESETS["rf_v5"]}, in_sample=True)
    auc = roc_auc(both, "target", "p", ["fold", "seen"])
    return rounded(auc.groupBy("fold").agg(F.max(F.when(F.col("seen"), F.col("auc"))).alias("train_auc"),
                                           F.max(F.when(~F.col("seen"), F.col("auc"))).alias("valid_auc")))


@query("gbt_presets")
def gbt_presets(spark, sf):
    """Every published boosted setting, CV AUC, gap bands."""
    presets = {n: t for n, t in B.PRESETS.items() if not t.forest}
    return rounded(RP.gap_report(V.cv_report(clf_setup(spark, sf), presets)))


@query("logistic_balanced")
def logistic_balanced(spark, sf):
    """L2 logistic regression (C = 0.1) with balanced class weights; coefficients."""
    s = clf_setup(spark, sf)
    b, b0 = newton.fit(stored(s.fit_rows(s.k), "rows"), {"all": newton.Logistic(0.1, balanced=True)}, "target")["all"]
    return rounded(spark.createDataFrame([*((c, float(w)) for c, w in zip(s.cols, b)), ("intercept", b0)], "feature string, coef double"))


def newton_sql(name="nt", src="f", weights="cw", splits=K, c=1.0):
    """Newton steps for two features and an intercept, by Cramer's rule, for each fold left out."""
    x = ["1.0", "x1", "x2"]
    sums = ", ".join([f"sum(w * (p - y) * {x[i]}) + {f'b{i}' if i else '0'} * {1 / c if i else 0} as g{i}" for i in range(3)]
                     + [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {1 / c if i == j and i else 0} as h{i}{j}" for i in range(3) for j in range(i, 3)])

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    down = [det([[f"g{r}" if c == k else h[r][c] for c in range(3)] for r in range(3)]) + " / " + det(h) for k in range(3)]
    return f"""
{name}(held, i, b0, b1, b2) as (
  select unnest(range(0, {splits})), 0, 0.0::double, 0.0::double, 0.0::double
  union all
  select held, i + 1, b0 - {down[0]}, b1 - {down[1]}, b2 - {down[2]}
  from (select held, i, b0, b1, b2, {sums}
        from (select {name}.*, x1, x2, y, case when y = 1 then {weights}.n / (2.0 * {weights}.pos)
                                               else {weights}.n / (2.0 * ({weights}.n - {weights}.pos)) end as w,
                     1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p
              from {name} join {src} on {src}.fold <> {name}.held join {weights} using (held) where i < 12) a
        group by held, i, b0, b1, b2) s)"""


@query("logistic_folds", f"""
with recursive f0 as (select doc_id, D as x1, G as x2, target as y from {docs.TRAIN_SQL} t),
f as (select *, cast((row_number() over (partition by y order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1) % 5 as integer) as fold
      from f0),
h as (select unnest(range(0, 5)) as held),
cw as (select held, count(*) as n, sum(y) as pos from h join f on f.fold <> h.held group by held),
{newton_sql()}
select cast(held as integer) as held, round(b1, 6) as coef_D, round(b2, 6) as coef_G, round(b0, 6) as intercept from nt where i = 12
""")
def logistic_folds(spark, sf):
    """M12 + M13: balanced logistic regressions on two features, every fold left out
    once, all fitted in the same passes."""
    rows = docs_folds(spark, sf, "D", "G").select("target", "fold", F.array("D", "G").alias("x"))
    got = newton.fit(stored(rows, "rows"), {str(f): newton.Logistic(1.0, f, True) for f in range(K)}, "target")
    return rounded(spark.createDataFrame([(int(f), float(b[0]), float(b[1]), b0) for f, (b, b0) in got.items()],
                                         "held int, coef_D double, coef_G double, intercept double"))


@query("oof_matrix")
def oof_matrix(spark, sf):
    """M14 + U2: out-of-fold predictions of the five models (each row scored once
    by each) and fold-averaged test predictions, stacked long."""
    s = clf_setup(spark, sf)
    oof, models = V.out_of_fold(s, FIVE)
    test = V.test_scores(s, models).withColumn("fold", F.lit(-1)).withColumn("target", F.lit(None).cast("int"))
    return rounded(oof.unionByName(test))


@query("oof_coverage", f"""
with f as (select doc_id, target, cast((row_number() over (partition by target
             order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1) % 5 as integer) as fold from {docs.TRAIN_SQL} t),
m as (select unnest(['lgb', 'xgb', 'cb', 'rf', 'gb']) as model)
select model, fold, count(*) as n, cast(sum(target) as bigint) as n_pos, count(*) as n_scored, cast(sum(doc_id) as bigint) as keys
from f, m group by model, fold
""")
def oof_coverage(spark, sf):
    """Who is scored where: rows, positives and keys per model and fold."""
    oof, _ = V.out_of_fold(clf_setup(spark, sf), FIVE)
    return oof.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("n_pos"),
        F.sum(F.col("p").between(0, 1).cast("long")).alias("n_scored"), F.sum("doc_id").alias("keys"))


@query("stack_logistic")
def stack_logistic(spark, sf):
    """Four base models under a balanced logistic meta-model (C = 0.01),
    fitted on inner out-of-fold predictions, five-fold CV AUC; test scores of
    the stack refitted on all rows."""
    oof, test = V.stack(clf_setup(spark, sf, inner=True), FOUR, 0.01)
    auc = cv_summary(roc_auc(oof, "target", "p", ["model", "fold"]), "auc", ["model"])
    scored = test.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"), F.avg("p").alias("test_mean"))
    return rounded(auc.join(scored, "model", "left"))


def two_level(spark, sf):
    """(per-model OOF AUC rows, fold-averaged test scores) of the two-level stack."""
    s = clf_setup(spark, sf)
    oof, models = V.out_of_fold(s, FIVE)
    names = list(FIVE)
    level1 = stored(V.wide(oof, "doc_id", names, "target", "fold"), "level1")
    test1 = stored(V.wide(V.test_scores(s, models), "doc_id", names), "test1")
    metas = {"meta_logistic": V.logistic(1.0), "meta_lightgbm": B.PRESETS["lgb_meta"]}
    frames = {f: level1.where(F.col("fold") != f) for f in range(K)}
    fitted = V.fit(s, metas, range(K), frames=frames)
    parts, tests = [], []
    for n in metas:
        for f in range(K):
            parts.append(fitted.score(level1.where(F.col("fold") == f), n, f)
                         .select("doc_id", "target", F.lit(n).alias("model"), "p"))
            tests.append(fitted.score(test1, n, f).select("doc_id", F.lit(n).alias("model"), "p"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / len(names)
    parts.append(level1.select("doc_id", "target", F.lit("mean_baseline").alias("model"), mean.alias("p")))
    tests.append(test1.select("doc_id", F.lit("mean_baseline").alias("model"), mean.alias("p")))
    auc = roc_auc(stored(V.union(parts), "level2"), "target", "p", ["model"]).select("model", "auc")
    return auc, V.union(tests).groupBy("doc_id", "model").agg(F.avg("p").alias("p"))


@query("stack_two_level")
def stack_two_level(spark, sf):
    """M16 + M22: meta models cross-fitted on the out-of-fold predictions of five
    models, fold-averaged test scores, baseline = their mean; best by OOF AUC."""
    auc, test = two_level(spark, sf)
    scored = test.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"), F.avg("p").alias("test_mean"))
    rep = stored(auc.join(scored, "model"), "report")
    best = rep.where("model <> 'mean_baseline'").agg(F.max_by("model", "auc")).first()[0]
    base = rep.where("model = 'mean_baseline'").first()["auc"]
    return rounded(rep.withColumn("best", F.col("model") == F.lit(best))
                   .withColumn("points_gain", RP.points_delta(F.col("auc") - F.lit(base))))


@query("oversample", f"""
with c as (select target, count(*) as n from {docs.TRAIN_SQL} t group by target)
select target, n as n_real, (select max(n) from c) - n as n_synthetic from c
""")
def oversample_q(spark, sf):
    """The smaller class of the labelled documents filled up with points
    between neighbours; rows per class."""
    s = clf_setup(spark, sf)
    got = oversample(stored(s.fit_rows(s.k), "rows"), "doc_id", "target")
    return got.groupBy("target").agg(F.sum((~F.col("synthetic")).cast("long")).alias("n_real"),
                                     F.sum(F.col("synthetic").cast("long")).alias("n_synthetic"))


NEAR_COLS = ["A", "B", "G", "H", "I"]
NEAR_SQL = f"""
t as (select doc_id as key, {", ".join(NEAR_COLS)} from {docs.TRAIN_SQL} t where target = 1),
d as (select a.key, b.key as neighbour, {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NEAR_COLS)} as d2
      from t a join t b on a.key <> b.key),
near as (select * from (select *, cast(row_number() over (partition by key order by d2, neighbour) as integer) as nth from d) where nth <= 5)
"""


def minority(spark, sf):
    """(key, x) of the labelled documents of low quality."""
    train = docs.train_table(Tables(spark, sf)).where("target = 1")
    return stored(train.select(F.col("doc_id").alias("key"), F.array(*[F.col(c).cast("double") for c in NEAR_COLS]).alias("x")), "minority")


@query("minority_neighbours", f"with {NEAR_SQL} select key, nth, neighbour, round(d2, 9) as d2 from near")
def minority_neighbours(spark, sf):
    """The five nearest rows of the class for every row of it, exactly."""
    return nearest(minority(spark, sf), 5).select("key", "nth", "neighbour", F.round("d2", 9).alias("d2"))


def _draw_sql(seed):
    return f"cast(('0x' || substr(md5('{seed}:' || cast(key as varchar) || ':' || cast(copy as varchar)), 1, 8))::bigint as double) / 4294967296.0"


@query("smote_points", f"""
with {NEAR_SQL},
c as (select count(*) filter (target = 0) - count(*) filter (target = 1) as need from {docs.TRAIN_SQL} t),
k as (select t.*, row_number() over (order by md5('42:' || cast(key as varchar)), key) as rank, (select count(*) from t) as n from t),
e as (select key, n, unnest(range(0, greatest(need // n + (rank <= need % n)::int, 0))) as copy from k, c),
deg as (select key, max(nth) as degree from near group by key),
w as (select e.key, cast(copy as integer) as copy, cast(floor({_draw_sql(43)} * degree) + 1 as integer) as nth, {_draw_sql(44)} as way
      from e join deg using (key))
select w.key, copy, near.neighbour, {", ".join(f"round(a.{c} + way * (b.{c} - a.{c}), 6) as {c}" for c in NEAR_COLS)}
from w join near using (key, nth) join t a on a.key = w.key join t b on b.key = near.neighbour
""")
def smote_points(spark, sf):
    """The synthetic rows that fill the smaller class up, each between a row
    and one of its neighbours."""
    n = docs.train_table(Tables(spark, sf)).groupBy().agg(F.sum(F.when(F.col("target") == 0, 1).otherwise(-1)).alias("need")).first()
    got = synthetic(minority(spark, sf), max(n["need"] or 0, 0), "key")
    return got.select("key", "copy", "neighbour", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(NEAR_COLS)])


# fixed values: the spaces of the two studies
COMMON = {"trees": Range(300, 1000, whole=True), "depth": Range(3, 7, whole=True), "step": Range(0.01, 0.1, log=True),
          "rows": Range(0.6, 0.9), "columns": Range(0.6, 0.9), "l1": Range(0.5, 5.0), "l2": Range(1.0, 5.0)}
STUDIES = {"xgb": COMMON | {"min_weight": Range(1, 10, whole=True), "min_gain": Range(0.0, 0.5)},
           "lgb": COMMON | {"leaves": Range(15, 63, whole=True), "min_rows": Range(10, 50, whole=True)}}
TRIALS = 30
SETTINGS = ["trees", "depth", "step", "rows", "columns", "l1", "l2", "min_weight", "min_gain", "leaves", "min_rows"]


@query("hyper_search")
def hyper_search(spark, sf):
    """Two guided studies of 30 trials, one for each boosted family: ten even
    draws, then Parzen proposals, five-fold CV AUC each. The trials of a batch of
    both studies are fitted at once."""
    s = clf_setup(spark, sf)
    running = {f: searching(space, TRIALS, seed=42) for f, space in STUDIES.items()}
    asked = {f: next(g) for f, g in running.items()}
    done, rows = {f: 0 for f in running}, []
    while asked:
        batch = {f"{f}_{done[f] + i:02d}": B.Trees(**v, balanced=True) for f, vs in asked.items() for i, v in enumerate(vs)}
        oof, _ = V.out_of_fold(s, batch)
        auc = {r["model"]: r for r in cv_summary(roc_auc(oof, "target", "p", ["model", "fold"]), "auc", ["model"]).collect()}
        following = {}
        for f, vs in asked.items():
            names = [f"{f}_{done[f] + i:02d}" for i in range(len(vs))]
            rows += [(f, done[f] + i, *(float(v[k]) if k in v else None for k in SETTINGS), auc[n]["auc_mean"], auc[n]["auc_std"])
                     for i, (n, v) in enumerate(zip(names, vs))]
            done[f] += len(vs)
            try:
                following[f] = running[f].send([auc[n]["auc_mean"] for n in names])
            except StopIteration:
                pass
        asked = following
    kinds = ", ".join(f"{k} double" for k in SETTINGS)
    rep = spark.createDataFrame(rows, f"family string, trial int, {kinds}, auc_mean double, auc_std double")
    best = Window.partitionBy("family").orderBy(F.desc("auc_mean"), "trial")  # a row per trial
    return rounded(rep.withColumn("best", F.row_number().over(best) == 1))


@query("regularisation_levels")
def regularisation_levels(spark, sf):
    """M25 + A11 + P20: train vs CV AUC for none / weak / strong settings, gap bands."""
    return rounded(RP.gap_report(V.cv_report(clf_setup(spark, sf), B.REG_LEVELS)))


def _ranked(spark, importances):
    df = spark.createDataFrame(importances, "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))


@query("importance_rank")
def importance_rank(spark, sf):
    """M26 + W1: random-forest importances, ranked (ties by name; a row per feature)."""
    s = clf_setup(spark, sf)
    model = final(s, {"rf": B.PRESETS["rf_v4"]}).trees["rf", s.k]
    return rounded(_ranked(spark, V.feature_importance(model, s.cols)))


@query("importance_select")
def importance_select(spark, sf):
    """Keep features of at least the median importance; the selector is
    fitted inside each fold. CV AUC with all and with the selected features."""
    from dataclasses import replace
    s = clf_setup(spark, sf)
    pair = {"all": B.PRESETS["lgb_v4"], "selected": replace(B.PRESETS["lgb_v4"], select=B.PRESETS["lgb_selector"])}
    kept = final(s, pair).trees["selected", s.k]["cols"]
    return rounded(V.cv_report(s, pair).withColumn(
        "n_features", F.when(F.col("model") == "all", len(s.cols)).otherwise(len(kept))))


def adversarial_setup(spark, sf) -> V.Setup:
    """Labelled and unlabelled documents together; the label is which."""
    train, test = docs.tables(Tables(spark, sf))
    u = kfold_stratified(tag_union(train.drop("target"), test), K, "is_test", "doc_id", 42)
    return V.setup(stored(u, "tagged"), K, "doc_id", "is_test", FeaturePlan(numeric=RAW_NUM, spec=()))


ADVERSARY = {"adversarial": B.PRESETS["lgb_adversarial"]}


@query("adversarial_validation")
def adversarial_validation(spark, sf):
    """M29 + A9 + P20: can a model tell labelled from unlabelled documents?
    Per-fold AUC, mean ± std, status and action ladders."""
    oof, _ = V.out_of_fold(adversarial_setup(spark, sf), ADVERSARY)
    r = cv_summary(roc_auc(oof, "is_test", "p", ["model", "fold"]), "auc", ["model"])
    return rounded(r.select("auc_mean", "auc_std", RP.drift_status(F.col("auc_mean")).alias("status"),
                            RP.drift_action(F.col("auc_mean")).alias("action")))


@query("adversarial_importance")
def adversarial_importance(spark, sf):
    """M29 + W1: the features that tell the two apart, ranked."""
    s = adversarial_setup(spark, sf)
    model = final(s, ADVERSARY).trees["adversarial", s.k]
    return rounded(_ranked(spark, V.feature_importance(model, s.cols)))


@query("drift_weighted_fit")
def drift_weighted_fit(spark, sf):
    """M30 + P27: out-of-fold adversarial scores on the labelled rows → weights
    p²/mean(p²) → weighted fit; CV AUC with and without the weights."""
    oof, _ = V.out_of_fold(adversarial_setup(spark, sf), ADVERSARY)
    w = stored(drift_weights(oof.where("is_test = 0").select("doc_id", "p"), "p", "dw"), "weights")
    s = clf_setup(spark, sf)
    s.rows = stored(s.rows.join(w.select("doc_id", "dw"), "doc_id"), "weighted")
    model = {"lgb": B.PRESETS["lgb_weights"]}
    s.weight = "dw"
    plain = V.cv_report(s, model).withColumn("model", F.lit("unweighted"))
    weighted = V.cv_report(s, model, weight="dw").withColumn("model", F.lit("drift_weighted"))
    top = w.agg(F.max("dw")).first()[0]
    return rounded(plain.unionByName(weighted).withColumn("max_weight", F.lit(float(top))))


@query("model_report")
def model_report(spark, sf):
    """M31 + O1 + A17 + A7 + P23 + P18: leaderboard by CV AUC (desc, name), the
    best model, and its accuracy on the held-out rows at threshold 0.5."""
    s = clf_setup(spark, sf)
    oof, _ = V.out_of_fold(s, FOUR)
    rep = cv_summary(roc_auc(oof, "target", "p", ["model", "fold"]), "auc", ["model"]).withColumnsRenamed(
        {"auc_mean": "cv_auc", "auc_std": "cv_std"}).drop("n_folds")
    acc = accuracy(oof.withColumn("cls", prob_to_class("p")), "target", "cls", ["model"])
    rep = stored(rep.join(acc, "model"), "report").withColumn("points", RP.auc_points(F.col("cv_auc")))
    one = Window.partitionBy(F.lit(0))  # a row per model
    return rounded(rep.withColumn("rank", F.row_number().over(one.orderBy(F.desc("cv_auc"), "model")))
                   .withColumn("best", F.col("rank") == 1))


@query("predict_unlabelled")
def predict_unlabelled(spark, sf):
    """M32 + S3: fit on all labelled rows, score the unlabelled documents."""
    s = clf_setup(spark, sf)
    return rounded(final(s, {"rf": B.PRESETS["rf_v5"]}).score(s.test_rows(s.k), "rf", s.k)
                   .select("doc_id", F.col("p").alias("target")))


@query("lasso_path", f"""
with recursive r as {R.SQL},
s as (select count(*) as n, avg(W0) as m1, avg(W1) as m2, avg(y) as my, var_pop(W0) as v1, var_pop(W1) as v2,
             covar_pop(W0, W1) as c12, covar_pop(W0, y) as c1y, covar_pop(W1, y) as c2y from r),
a as (select unnest([0.001, 0.01, 0.1]) as alpha),
cd(alpha, i, b1, b2) as (
  select alpha, 0, 0.0::double, 0.0::double from a
  union all
  select alpha, i + 1, nb1, sign(c2y - c12 * nb1) * greatest(abs(c2y - c12 * nb1) - alpha, 0) / v2
  from (select alpha, i, b2, sign(c1y - c12 * b2) * greatest(abs(c1y - c12 * b2) - alpha, 0) / v1 as nb1, c12, c2y, v2
        from cd, s where i < 200) t),
e as (select alpha, b1, b2, my - b1 * m1 - b2 * m2 as b0 from cd, s where i = 200)
select alpha, round(b1, 4) as coef_W0, round(b2, 4) as coef_W1, round(b0, 4) as intercept,
       round((select avg((y - b0 - b1 * W0 - b2 * W1) * (y - b0 - b1 * W0 - b2 * W1)) from r), 4) as mse from e
""")
def lasso_path(spark, sf):
    """M3: lasso coefficients over alpha, with in-sample MSE
    (oracle: coordinate descent on the moments)."""
    df = stored(M.assemble(R.table(Tables(spark, sf)), ["W0", "W1"]), "rows")
    rows = []
    for alpha in (0.001, 0.01, 0.1):
        m = M.lasso(alpha, "y").fit(df)
        mse = regression_metrics(m.transform(df), "y", "prediction").first()["mse"]
        rows.append((alpha, float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept), float(mse)))
    got = spark.createDataFrame(rows, "alpha double, coef_W0 double, coef_W1 double, intercept double, mse double")
    return got.select("alpha", *[F.round(c, 4).alias(c) for c in got.columns[1:]])
