"""Regression queries: OLS / ridge fits (M1, M2, M4), Gram matrix, metrics
(A6, P22, J8, O2) and the CV fit diagnosis (M13, A9, A11, P21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import forests as FO
from ..operators import gram as G
from ..operators import models as M
from ..operators.concurrent import at_once
from ..operators.features import poly2
from ..operators.folds import kfold_contiguous, kfold_shuffled
from ..operators.metrics import regression_metrics
from ..operators.util import stored
from ..operators.validate import cross_validate, fit_diagnosis, quality_band, union
from ..sources.tables import Tables
from . import regression as R
from .registry import query, rounded

# closed form of 2-feature OLS from centred cross-products (Cramer's rule)
OLS2_CTE = f"""
r as {R.SQL},
m as (select covar_pop(W0, W0) as s11, covar_pop(W1, W1) as s22, covar_pop(W0, W1) as s12,
             covar_pop(W0, y) as s1y, covar_pop(W1, y) as s2y, avg(W0) as m1, avg(W1) as m2, avg(y) as my
      from r),
c as (select (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2, m1, m2, my from m),
cf as (select b1, b2, my - b1 * m1 - b2 * m2 as b0 from c)
"""


def _fit(df, cols, est):
    a = M.assemble(df, cols)
    return est.fit(a), a


@query("ols_1", f"""
with r as {R.SQL}
select round(regr_slope(y, W0), 6) as coef_W0, round(regr_intercept(y, W0), 6) as intercept from r
""")
def ols_1(spark, sf):
    """M1: OLS with one feature."""
    model, _ = _fit(R.table(Tables(spark, sf)), ["W0"], M.linear("y"))
    return rounded(spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                         "coef_W0 double, intercept double"))


@query("ols_2", f"""
with {OLS2_CTE}
select round(b1, 6) as coef_W0, round(b2, 6) as coef_W1, round(b0, 6) as intercept from cf
""")
def ols_2(spark, sf):
    """M1: OLS with two features."""
    model, _ = _fit(R.table(Tables(spark, sf)), ["W0", "W1"], M.linear("y"))
    c = model.coefficients
    return rounded(spark.createDataFrame([(float(c[0]), float(c[1]), float(model.intercept))],
                                         "coef_W0 double, coef_W1 double, intercept double"))


RIDGE_ALPHA = 10.0


@query("ridge_1", f"""
with r as {R.SQL},
m as (select regr_sxy(y, W0) as sxy, regr_sxx(y, W0) as sxx, avg(W0) as mx, avg(y) as my from r)
select round(sxy / (sxx + {RIDGE_ALPHA}), 6) as coef_W0,
       round(my - sxy / (sxx + {RIDGE_ALPHA}) * mx, 6) as intercept from m
""")
def ridge_1(spark, sf):
    """M2: ridge (alpha = 10) with one feature; unpenalised intercept."""
    df = R.table(Tables(spark, sf))
    st = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sd")).first()
    model, _ = _fit(df, ["W0"], M.ridge(RIDGE_ALPHA, st["n"], st["sd"], "y"))
    return rounded(spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                         "coef_W0 double, intercept double"))


@query("gram_matrix", f"""
with r as {R.SQL}
select * from (
  select 'one' as row_name, 'one' as col_name, count(*)::double as value from r
  union all select 'one', 'W0', round(sum(W0), 4) from r
  union all select 'one', 'W1', round(sum(W1), 4) from r
  union all select 'W0', 'W0', round(sum(W0 * W0), 4) from r
  union all select 'W0', 'W1', round(sum(W0 * W1), 4) from r
  union all select 'W1', 'W1', round(sum(W1 * W1), 4) from r
  union all select 'one', 'y', round(sum(y), 4) from r
  union all select 'W0', 'y', round(sum(W0 * y), 4) from r
  union all select 'W1', 'y', round(sum(W1 * y), 4) from r)
""")
def gram_matrix(spark, sf):
    """Normal-equation sufficient statistics X'X and X'y (one distributed aggregate)."""
    df = R.table(Tables(spark, sf)).withColumn("one", F.lit(1.0))
    names = ["one", "W0", "W1"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]] + [(a, "y") for a in names]
    row = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    out = spark.createDataFrame([(a, b, float(row[f"{a}|{b}"])) for a, b in pairs],
                                "row_name string, col_name string, value double")
    return out.select("row_name", "col_name", F.round("value", 4).alias("value"))


@query("regression_metrics", f"""
with {OLS2_CTE},
p as (select y, b0 + b1 * W0 + b2 * W1 as p from r, cf)
select count(*) as n, round(avg((y - p) * (y - p)), 6) as mse,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2,
       round(avg(abs(y - p)), 6) as mae, round(max(abs(y - p)), 6) as max_abs_err
from p
""")
def regression_metrics_q(spark, sf):
    """A6 + P22: in-sample MSE, R², MAE, max absolute error of the 2-feature OLS."""
    model, a = _fit(R.table(Tables(spark, sf)), ["W0", "W1"], M.linear("y"))
    return rounded(regression_metrics(model.transform(a), "y", "prediction"))


@query("predict_head", f"""
with {OLS2_CTE}
select p_partkey, round(y, 6) as actual, round(b0 + b1 * W0 + b2 * W1, 6) as predicted,
       round(abs(y - (b0 + b1 * W0 + b2 * W1)), 6) as abs_error
from r, cf order by p_partkey limit 10
""")
def predict_head(spark, sf):
    """J8 + O2: actual vs predicted for the first 10 keys (an ordered top-k)."""
    model, a = _fit(R.table(Tables(spark, sf)), ["W0", "W1"], M.linear("y"))
    p = model.transform(a)
    return rounded(p.orderBy("p_partkey").limit(10).select(
        "p_partkey", F.col("y").alias("actual"), F.col("prediction").alias("predicted"),
        F.abs(F.col("y") - F.col("prediction")).alias("abs_error")))


POLY = ["W0", "W1", "W0_W0", "W0_W1", "W1_W1"]


@query("poly2_fit", f"""
with r as (select y, W0, W1, W0 * W0 as W0_W0, W0 * W1 as W0_W1, W1 * W1 as W1_W1 from {R.SQL} t)
select count(*) as n, {', '.join(f"round(corr(y, {c}), 4) as corr_{c}, cast(0 as bigint) as gradient_{c}" for c in POLY)},
       cast(1 as integer) as quadratic
from r
""")
def poly2_fit(spark, sf):
    """M4: degree-2 expansion + OLS. A least-squares fit is one whose residuals
    are orthogonal to every feature: the gradients, in units of 1e-4 of the
    feature's and target's spread, are 0. In-sample MSE < 1 ⇒ quadratic target."""
    df = poly2(R.table(Tables(spark, sf)), ["W0", "W1"])
    model, a = _fit(df, POLY, M.linear("y"))
    p = stored(model.transform(a).select("y", *POLY, (F.col("y") - F.col("prediction")).alias("e")), "fitted")
    slope = [F.abs(F.round(F.covar_pop("e", c) / F.greatest(F.stddev_pop("y") * F.stddev_pop(c), F.lit(1e-12)) * 1e4))
             .cast("long").alias(f"gradient_{c}") for c in POLY]
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.corr("y", c), 4).alias(f"corr_{c}") for c in POLY], *slope,
                 (F.avg(F.col("e") * F.col("e")) < 1).cast("int").alias("quadratic"))


def _cv_frame(spark, sf):
    df = kfold_shuffled(R.table(Tables(spark, sf)), 5, "p_partkey", 42)
    return M.assemble(df, ["W0", "W1"])


FOLD_SQL = f"""
r0 as {R.SQL},
r as (select *, cast((row_number() over (order by md5('42:' || cast(p_partkey as varchar)), p_partkey) - 1) % 5
                    as integer) as fold from r0),
fs as (select fold, count(*) as n, sum(W0) as s1, sum(W1) as s2, sum(y) as sy, sum(W0 * W0) as s11,
              sum(W1 * W1) as s22, sum(W0 * W1) as s12, sum(W0 * y) as s1y, sum(W1 * y) as s2y from r group by fold),
tot as (select sum(n) as n, sum(s1) as s1, sum(s2) as s2, sum(sy) as sy, sum(s11) as s11, sum(s22) as s22,
               sum(s12) as s12, sum(s1y) as s1y, sum(s2y) as s2y from fs),
tr as (select fs.fold, tot.n - fs.n as n, tot.s1 - fs.s1 as s1, tot.s2 - fs.s2 as s2, tot.sy - fs.sy as sy,
              tot.s11 - fs.s11 as s11, tot.s22 - fs.s22 as s22, tot.s12 - fs.s12 as s12,
              tot.s1y - fs.s1y as s1y, tot.s2y - fs.s2y as s2y from fs, tot),
cm as (select fold, s11 - s1 * s1 / n as c11, s22 - s2 * s2 / n as c22, s12 - s1 * s2 / n as c12,
              s1y - s1 * sy / n as c1y, s2y - s2 * sy / n as c2y, s1 / n as m1, s2 / n as m2, sy / n as my from tr),
cf as (select fold, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) as b1,
              (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) as b2, m1, m2, my from cm),
cf2 as (select fold, b1, b2, my - b1 * m1 - b2 * m2 as b0 from cf),
pv as (select r.fold, y, b0 + b1 * W0 + b2 * W1 as p from r join cf2 using (fold)),
pt as (select cf2.fold, y, b0 + b1 * W0 + b2 * W1 as p from r join cf2 on r.fold <> cf2.fold),
mv as (select fold, avg((y - p) * (y - p)) as valid_mse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as valid_r2
       from pv group by fold),
mt as (select fold, avg((y - p) * (y - p)) as train_mse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as train_r2
       from pt group by fold)
"""


@query("cv_folds_regression", f"""
with {FOLD_SQL}
select fold, round(train_mse, 6) as train_mse, round(train_r2, 6) as train_r2,
       round(valid_mse, 6) as valid_mse, round(valid_r2, 6) as valid_r2
from mv join mt using (fold)
""")
def cv_folds_regression(spark, sf):
    """M13 + A11 per fold: train and validation MSE / R² of OLS over shuffled folds."""
    return rounded(cross_validate(lambda: M.linear("y"), _cv_frame(spark, sf), 5, "y"))


@query("fit_diagnosis", f"""
with {FOLD_SQL},
fc as (select s11 - s1 * s1 / n as c11, s22 - s2 * s2 / n as c22, s12 - s1 * s2 / n as c12,
               s1y - s1 * sy / n as c1y, s2y - s2 * sy / n as c2y, s1 / n as m1, s2 / n as m2, sy / n as my from tot),
fb as (select (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) as b1,
              (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) as b2, m1, m2, my from fc),
fb2 as (select b1, b2, my - b1 * m1 - b2 * m2 as b0 from fb),
full_fit as (select avg((y - (b0 + b1 * W0 + b2 * W1)) * (y - (b0 + b1 * W0 + b2 * W1))) as train_mse,
                    1 - sum((y - (b0 + b1 * W0 + b2 * W1)) * (y - (b0 + b1 * W0 + b2 * W1))) / (var_pop(y) * count(*)) as train_r2
             from r, fb2),
cvs as (select avg(valid_mse) as cv_mse, stddev_pop(valid_mse) as cv_mse_std,
               avg(valid_r2) as cv_r2, stddev_pop(valid_r2) as cv_r2_std from mv),
d as (select *, abs(train_mse - cv_mse) / train_mse * 100 as relative_gap from full_fit, cvs)
select round(train_mse, 6) as train_mse, round(train_r2, 6) as train_r2, round(cv_mse, 6) as cv_mse,
       round(cv_mse_std, 6) as cv_mse_std, round(cv_r2, 6) as cv_r2, round(cv_r2_std, 6) as cv_r2_std,
       round(relative_gap, 4) as relative_gap,
       case when train_r2 > 0.9 and cv_r2 < 0.7 then 'high_overfit'
            when train_r2 < 0.5 and cv_r2 < 0.5 then 'underfit'
            when relative_gap < 10 then 'good' else 'moderate_overfit' end as diagnosis,
       case when cv_r2 < 0.3 then 'poor' when cv_r2 < 0.6 then 'moderate' else 'good' end as quality
from d
""")
def fit_diagnosis_q(spark, sf):
    """P21 + A9 + A11: train vs cross-validated fit, relative gap, verdicts."""
    cv = cross_validate(lambda: M.linear("y"), _cv_frame(spark, sf), 5, "y")
    model, a = _fit(R.table(Tables(spark, sf)), ["W0", "W1"], M.linear("y"))
    full = regression_metrics(model.transform(a), "y", "prediction").select(
        F.col("mse").alias("train_mse"), F.col("r2").alias("train_r2"))
    cvs = cv.agg(F.avg("valid_mse").alias("cv_mse"), F.stddev_pop("valid_mse").alias("cv_mse_std"),
                 F.avg("valid_r2").alias("cv_r2"), F.stddev_pop("valid_r2").alias("cv_r2_std"))
    row = {**full.first().asDict(), **cvs.first().asDict()}
    d = spark.createDataFrame([row]).select(*[F.col(c).cast("double") for c in
                                              ["train_mse", "train_r2", "cv_mse", "cv_mse_std", "cv_r2", "cv_r2_std"]])
    d = d.withColumn("relative_gap", F.abs(F.col("train_mse") - F.col("cv_mse")) / F.col("train_mse") * 100)
    d = d.withColumn("diagnosis", fit_diagnosis(F.col("train_r2"), F.col("cv_r2"), F.col("relative_gap")))
    d = d.withColumn("quality", quality_band(F.col("cv_r2")))
    return rounded(d).withColumn("relative_gap", F.round("relative_gap", 4))


# ---- model comparison of the regression study ------------------------------------

CONTIGUOUS_SQL = FOLD_SQL.replace(
    "cast((row_number() over (order by md5('42:' || cast(p_partkey as varchar)), p_partkey) - 1) % 5\n                    as integer)",
    "cast(ntile(5) over (order by p_partkey) - 1 as integer)")
RIDGE_SQL = CONTIGUOUS_SQL.replace(
    "cf as (select fold,", "al as (select * from (values ('Linear Regression', 0.0), ('Ridge (1)', 1.0), ('Ridge (10)', 10.0)) v(model, alpha)),\n"
    "cf as (select model, fold,").replace("c11 * c22 - c12 * c12", "(c11 + alpha) * (c22 + alpha) - c12 * c12") \
    .replace("c1y * c22 -", "c1y * (c22 + alpha) -").replace("c2y * c11 -", "c2y * (c11 + alpha) -") \
    .replace("m1, m2, my from cm)", "m1, m2, my from cm, al)").replace("cf2 as (select fold,", "cf2 as (select model, fold,") \
    .replace("pv as (select r.fold,", "pv as (select model, r.fold,").replace("mv as (select fold,", "mv as (select model, fold,") \
    .replace("from pv group by fold)", "from pv group by model, fold)")
RIDGE_SQL = RIDGE_SQL[:RIDGE_SQL.index("pt as (")] + RIDGE_SQL[RIDGE_SQL.index("mv as ("):RIDGE_SQL.index("mt as (")].rstrip().rstrip(",")

#: Features and fit from moments, by model.
W, POLY_AT = [0, 1], list(range(len(POLY)))
LINEAR = {"Linear Regression": (W, G.ridge), "Ridge (1)": (W, lambda m: G.ridge(m, 1.0)),
          "Ridge (10)": (W, lambda m: G.ridge(m, 10.0)), "Lasso (0.1)": (W, lambda m: G.lasso(m, 0.1)),
          "Poly-2 + Linear": (POLY_AT, G.ridge), "Poly-2 + Ridge": (POLY_AT, lambda m: G.ridge(m, 1.0))}


def comparison_rows(spark, sf):
    """The regression table in five contiguous folds with its degree-2 terms."""
    df = poly2(kfold_contiguous(R.table(Tables(spark, sf)), 5, ["p_partkey"]), ["W0", "W1"])
    return stored(df, "regression")


def linear_errors(df, names):
    """[(model, fold, rows, mse)] of linear models on their held-out folds, from one scan."""
    folds = G.fold_moments(df, POLY, "y")
    rows = []
    for n in names:
        at, fit = LINEAR[n]
        own = {f: G.of(m, at) for f, m in folds.items()}
        rows += [(n, f, held.n, G.mse(held, model)) for f, (_, held, model) in G.cross_validated(own, fit).items()]
    return rows


def assembled(df):
    """The rows with a feature vector, written once for all fits, in as many
    files as their size asks for: a fit is many small jobs."""
    keep = M.assemble(df, ["W0", "W1"]).select("p_partkey", "fold", "y", "W0", "W1", "features")
    return stored(keep.repartition(max(1, df.count() // TASK_ROWS)), "assembled")


TASK_ROWS = 100_000


def tree_predictions(df, trees):
    """(model, fold, p_partkey, y, p) of every tree regressor on its held-out
    folds: all fits at once, each on all rows outside its fold, scored where the
    fold lies. All forests are fitted in the same pass."""
    rows = assembled(df)
    wooded = {n: t for n, t in trees.items() if t.forest}

    def forests():
        got = FO.fit_cells(rows, ["W0", "W1"], "y", wooded, {f: f for f in range(5)})
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), FO.score_cells(got, n, F.col("fold"), ["W0", "W1"]).alias("p"))
                                   for n in wooded])).alias("s")
        return stored(rows.select("fold", "p_partkey", "y", each).select("s.model", "fold", "p_partkey", "y", "s.p"), "held")

    def one(name, f):
        def run():
            model = M.tree_regressor(trees[name], "y").fit(rows.where(F.col("fold") != f))
            return stored(model.transform(rows.where(F.col("fold") == f)).select(
                F.lit(name).alias("model"), "fold", "p_partkey", "y", F.col("prediction").alias("p")), "held")
        return run
    work = {f"{n} {f}": one(n, f) for n in trees if n not in wooded for f in range(5)}
    got = at_once(df.sparkSession, {**({"forests": forests} if wooded else {}), **work})
    return union(list(got.values()))


def held_out_errors(df, names, trees):
    """(model, fold, mse) of every model on its held-out fold."""
    spark, parts = df.sparkSession, []
    if names:
        parts.append(spark.createDataFrame([(n, f, e) for n, f, _, e in linear_errors(df, names)], "model string, fold int, mse double"))
    if trees:
        e = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))
        parts.append(tree_predictions(df, trees).groupBy("model", "fold").agg(F.avg(e).alias("mse")))
    return union(parts)


@query("cv_linear_family", f"""
with {RIDGE_SQL}
select model, round(avg(valid_mse), 5) as cv_mse, round(stddev_pop(valid_mse), 5) as cv_std from mv group by model
""")
def cv_linear_family(spark, sf):
    """M1 + M2 + W2 + M13: OLS and both ridges over unshuffled five folds."""
    errors = held_out_errors(comparison_rows(spark, sf), ["Linear Regression", "Ridge (1)", "Ridge (10)"], {})
    r = errors.groupBy("model").agg(F.avg("mse").alias("cv_mse"), F.stddev_pop("mse").alias("cv_std"))
    return r.select("model", F.round("cv_mse", 5).alias("cv_mse"), F.round("cv_std", 5).alias("cv_std"))


def leaderboard(spark, sf):
    df = comparison_rows(spark, sf)
    errors = held_out_errors(df, [*LINEAR], B.REGRESSORS)
    board = stored(errors.groupBy("model").agg(F.avg("mse").alias("cv_mse"), F.stddev_pop("mse").alias("cv_std")), "board")
    return df, board, board.orderBy("cv_mse", "model").first()["model"]


def refitted(df, name):
    """``df`` with the predictions ``p`` of a regressor fitted on all of its rows."""
    if name in B.REGRESSORS:
        rows = assembled(df)
        if B.REGRESSORS[name].forest:
            got = FO.fit_cells(rows, ["W0", "W1"], "y", {name: B.REGRESSORS[name]}, {0: None})
            return rows.withColumn("p", FO.score_cells(got, name, F.lit(0), ["W0", "W1"]))
        return M.tree_regressor(B.REGRESSORS[name], "y").fit(rows).transform(rows).withColumn("p", F.col("prediction"))
    at, fit = LINEAR[name]
    b, b0 = fit(G.of(G.total(G.fold_moments(df, POLY, "y")), at))
    p = F.lit(float(b0))
    for i, w in zip(at, b):
        p = p + F.lit(float(w)) * F.col(POLY[i])
    return df.withColumn("p", p)


@query("regression_compare")
def regression_compare(spark, sf):
    """M1–M6 + O1 + A17: nine regressors, CV MSE over unshuffled five folds,
    ascending, the best marked."""
    _, board, best = leaderboard(spark, sf)
    return rounded(board.withColumn("best", F.col("model") == F.lit(best)).orderBy("cv_mse", "model"))


@query("regression_predict")
def regression_predict(spark, sf):
    """S3/S4 + A5: the best regressor refitted on all rows; predictions rounded to
    three places, with the minimum, maximum, mean and deviation over the table."""
    df, _, best = leaderboard(spark, sf)
    got = stored(refitted(df, best).select("p_partkey", "W0", "W1", "p"), "predictions")
    t = got.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std")).first()
    return got.select("p_partkey", "W0", "W1", F.bround("p", 3).alias("mse"),
                      *[F.round(F.lit(t[c]), 6).alias(f"p_{c}") for c in ("lo", "hi", "mean", "std")])


@query("rf_reg")
def rf_reg(spark, sf):
    """M5: both forest regressors, MSE per held-out fold."""
    return rounded(held_out_errors(comparison_rows(spark, sf), [], {n: t for n, t in B.REGRESSORS.items() if t.forest}))


@query("gbt_reg")
def gbt_reg(spark, sf):
    """M6: gradient-boosting regressor, MSE per held-out fold."""
    return rounded(held_out_errors(comparison_rows(spark, sf), [], {n: t for n, t in B.REGRESSORS.items() if not t.forest}))


@query("regression_coverage", f"""
with {CONTIGUOUS_SQL[:CONTIGUOUS_SQL.index("fs as (")].rstrip().rstrip(",")},
m as (select unnest([{", ".join(f"'{n}'" for n in B.REGRESSORS)}]) as model)
select model, fold, count(*) as n, cast(sum(p_partkey) as bigint) as keys, count(*) as n_finite from r, m group by model, fold
""")
def regression_coverage(spark, sf):
    """M5 + M6 + M13: which rows each tree regressor scored while held out."""
    got = tree_predictions(comparison_rows(spark, sf), B.REGRESSORS)
    return got.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"),
        F.sum((F.col("p").isNotNull() & ~F.isnan("p")).cast("long")).alias("n_finite"))


@query("cv_lasso", f"""
with recursive {CONTIGUOUS_SQL[:CONTIGUOUS_SQL.index("cf as (")].rstrip().rstrip(",")},
cd(fold, i, b1, b2) as (
  select fold, 0, 0.0::double, 0.0::double from cm
  union all
  select fold, i + 1, nb1, sign(k2y - k12 * nb1) * greatest(abs(k2y - k12 * nb1) - 0.1, 0) / k22
  from (select cd.fold, i, c2y / n as k2y, c12 / n as k12, c22 / n as k22,
               sign(c1y / n - c12 / n * b2) * greatest(abs(c1y / n - c12 / n * b2) - 0.1, 0) / (c11 / n) as nb1
        from cd join cm using (fold) join tr using (fold) where i < 200) t),
cf2 as (select fold, b1, b2, my - b1 * m1 - b2 * m2 as b0 from cd join cm using (fold) where i = 200)
select r.fold, round(any_value(b1), 5) as coef_W0, round(any_value(b2), 5) as coef_W1,
       round(avg((y - b0 - b1 * W0 - b2 * W1) * (y - b0 - b1 * W0 - b2 * W1)), 5) as mse
from r join cf2 using (fold) group by r.fold
""")
def cv_lasso(spark, sf):
    """M3 + M13: the lasso of every fold and its held-out error, from the moments of one scan."""
    folds = {f: G.of(m, W) for f, m in G.fold_moments(comparison_rows(spark, sf), POLY, "y").items()}
    rows = [(f, *map(float, model[0]), G.mse(held, model))
            for f, (_, held, model) in G.cross_validated(folds, lambda m: G.lasso(m, 0.1)).items()]
    got = spark.createDataFrame(rows, "fold int, coef_W0 double, coef_W1 double, mse double")
    return got.select("fold", *[F.round(c, 5).alias(c) for c in ("coef_W0", "coef_W1", "mse")])
