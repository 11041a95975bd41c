"""Stacks of logistic models whose every number SQL can make again (M14–M16, M19,
M22, M31, M32, A7, A17, O1).

Two base models over the labelled documents, one on length and word variety,
one on the shares of marks and digits, meet in a balanced logistic meta-model.
The twin in SQL takes the Newton steps of all splits in recursive queries.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import prob_to_class
from ..operators import ensemble as EN
from ..operators import newton
from ..operators.metrics import accuracy, cv_summary, roc_auc
from ..operators.stacking import MEAN, STACK, cross_fit
from ..operators.util import stored
from ..sources.tables import Tables
from . import docs
from .q_core import docs_folds
from .q_ensemble import _auc_cte
from .q_models import newton_sql
from .registry import query, rounded

K = 5
COLS = ["D", "G", "B", "H"]
BASES = {"lengths": newton.Logistic(1.0, balanced=True, columns=(0, 1)),
         "marks": newton.Logistic(10.0, balanced=True, columns=(2, 3))}
META = newton.Logistic(0.1, balanced=True)
#: Places of a probability that count, so that equal scores are equal in both engines.
PLACES = 9


def _sigmoid(t, x1, x2):
    return f"1 / (1 + exp(-({t}.b0 + {t}.b1 * {x1} + {t}.b2 * {x2})))"


def _fit_sql(name, src, c):
    """CTEs of the balanced fits on ``src`` (y, fold, x1, x2): ``name`` has the coefficients by split; split 5 holds nothing out."""
    return f"""
{name}_w as (select held, count(*) as n, sum(y) as pos from h join {src} on {src}.fold <> h.held group by held),
{newton_sql(f"{name}_n", src, f"{name}_w", K + 1, c)},
{name} as (select * from {name}_n where i = 12)"""


STACK_SQL = f"""
f0 as (select doc_id, {", ".join(COLS)}, target as y from {docs.TRAIN_SQL} t),
f as (select *, cast((row_number() over (partition by y order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1) % {K} as integer) as fold
      from f0),
h as (select unnest(range(0, {K + 1})) as held),
f_a as (select doc_id, y, fold, D as x1, G as x2 from f),
f_b as (select doc_id, y, fold, B as x1, H as x2 from f),
{_fit_sql("fit_a", "f_a", 1.0)},
{_fit_sql("fit_b", "f_b", 10.0)},
level1 as (select f.doc_id, f.y, f.fold, {_sigmoid("a", "D", "G")} as x1, {_sigmoid("b", "B", "H")} as x2
           from f join fit_a a on a.held = f.fold join fit_b b on b.held = f.fold),
{_fit_sql("fit_m", "level1", 0.1)}"""


def stacked(spark, sf):
    """(out-of-fold predictions, the stack) of the labelled documents."""
    rows = docs_folds(spark, sf, *COLS).select("doc_id", "target", "fold", F.array(*COLS).alias("x"))
    return cross_fit(stored(rows, "rows"), BASES, META, K, len(COLS), "doc_id", "target")


OOF_SQL = f"""
oof as (select doc_id, y, fold, model, round(p, {PLACES}) as p from (
  select doc_id, y, fold, 'lengths' as model, x1 as p from level1
  union all select doc_id, y, fold, 'marks', x2 from level1
  union all select doc_id, y, fold, '{MEAN}', (x1 + x2) / 2 from level1
  union all select doc_id, y, fold, '{STACK}', {_sigmoid("m", "x1", "x2")} from level1 join fit_m m on m.held = level1.fold) u)"""


@query("stack_linear_oof", f"""
with recursive {STACK_SQL}, {OOF_SQL}
select doc_id, cast(y as integer) as target, fold, model, round(p, 6) as p from oof
""")
def stack_linear_oof(spark, sf):
    """M14 + M16 + M22 + U2: out-of-fold predictions of the base models, their mean and the stack."""
    return rounded(stacked(spark, sf)[0].withColumn("p", F.round("p", PLACES)))


@query("stack_linear", f"""
with recursive {STACK_SQL}, {OOF_SQL},
{_auc_cte("by_fold", "oof", "model, fold", "p", "y")},
{_auc_cte("pooled", "oof", "model", "p", "y")},
s as (select model, avg(auc) as auc_mean, stddev_pop(auc) as auc_std from by_fold group by model),
a as (select model, avg(case when (p > 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy from oof group by model),
r as (select model, auc_mean, auc_std, pooled.auc as auc_pooled, accuracy,
             cast(row_number() over (order by round(auc_mean, 6) desc, model) as integer) as rank
      from s join a using (model) join pooled using (model))
select model, round(auc_mean, 6) as auc_mean, round(auc_std, 6) as auc_std, round(auc_pooled, 6) as auc_pooled,
       round(accuracy, 6) as accuracy, rank, rank = 1 as best from r
""")
def stack_linear(spark, sf):
    """M15 + M16 + M31 + A7 + A17 + O1: base models, their mean and the stack by cross-fitted
    AUC (mean and spread over the folds, pooled), accuracy at 0.5, rank and best."""
    oof = stored(stacked(spark, sf)[0].withColumn("p", F.round("p", PLACES)), "oof")
    rep = cv_summary(roc_auc(oof, "target", "p", ["model", "fold"]), "auc", ["model"]).drop("n_folds")
    rep = rep.join(roc_auc(oof, "target", "p", ["model"]).select("model", F.col("auc").alias("auc_pooled")), "model")
    rep = stored(rep.join(accuracy(oof.withColumn("cls", prob_to_class("p")), "target", "cls", ["model"]), "model"), "report")
    one = Window.partitionBy(F.lit(0))  # a row per model
    return rounded(rep.withColumn("rank", F.row_number().over(one.orderBy(F.round("auc_mean", 6).desc(), "model")))
                   .withColumn("best", F.col("rank") == 1))


@query("stack_linear_predict", f"""
with recursive {STACK_SQL},
t as (select doc_id, D, G, B, H from {docs.TEST_SQL} t),
b as (select doc_id, {_sigmoid("a", "D", "G")} as x1, {_sigmoid("b", "B", "H")} as x2
      from t, (select * from fit_a where held = {K}) a, (select * from fit_b where held = {K}) b)
select doc_id, round({_sigmoid("m", "x1", "x2")}, 6) as target from b, (select * from fit_m where held = {K}) m
""")
def stack_linear_predict(spark, sf):
    """M15 + M32 + S3: the stack fitted on all labelled documents scores the unlabelled ones."""
    _, stack = stacked(spark, sf)
    test = docs.test_table(Tables(spark, sf)).select("doc_id", F.array(*COLS).alias("x"))
    return rounded(stack.predict(test, out="target").select("doc_id", "target"))


CALIBRATED_SQL = f"""
raw as (select doc_id, y, fold, round(x2, {PLACES}) as p from level1),
seen as (select held, y, p from h join raw on raw.fold <> held where held < {K}),
g as (select held, p, count(*) as n, sum(y) as pos, row_number() over (partition by held order by p) as i from seen group by held, p),
gc as (select *, sum(n) over w as cn, sum(pos) over w as cp from g window w as (partition by held order by i)),
ab as (select a.held, a.i as a, b.i as b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) as m
       from gc a join gc b on a.held = b.held and a.i <= b.i),
lo as (select held, b, min(m) over (partition by held, a order by b desc) as mn from ab),
cal as (select held, b as i, max(mn) as v from lo group by held, b),
near as (select raw.doc_id, raw.y, raw.fold, raw.p, max(g.p) filter (g.p <= raw.p) as p0, max(v) filter (g.p <= raw.p) as v0,
                min(g.p) filter (g.p >= raw.p) as p1, min(v) filter (g.p >= raw.p) as v1
         from raw join g on g.held = raw.fold join cal on cal.held = g.held and cal.i = g.i group by all),
c as (select held, sum(y) as np, count(*) - sum(y) as nn from seen group by held),
d as (select held, p, case when y = 1 then (np + 1) / (np + 2) else 1 / (nn + 2) end as t, count(*) as k from seen join c using (held) group by all),
nw(i, held, a, b) as (
  select 0, held, 0.0::double, 0.0::double from c
  union all
  select i + 1, held, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (select i, held, a, b, sum(k * (q - t) * p) as g1, sum(k * (q - t)) as g2, sum(k * q * (1 - q) * p * p) as h11,
               sum(k * q * (1 - q) * p) as h12, sum(k * q * (1 - q)) as h22
        from (select nw.i, nw.held, a, b, p, t, k, 1 / (1 + exp(-(a * p + b))) as q from nw join d using (held) where nw.i < 25) x
        group by i, held, a, b) z),
kinds as (select kind, y, fold, round(p, {PLACES}) as p from (
  select 'raw' as kind, y, fold, p from raw
  union all select 'isotonic', y, fold, case when p0 is null then v1 when p1 is null or p1 = p0 then v0
                                             else v0 + (v1 - v0) * (p - p0) / (p1 - p0) end from near
  union all select 'sigmoid', y, fold, 1 / (1 + exp(-(a * p + b))) from raw join nw on held = fold and i = 25) u)"""


@query("calibration_choice", f"""
with recursive {STACK_SQL}, {CALIBRATED_SQL},
{_auc_cte("by_fold", "kinds", "kind, fold", "p", "y")},
s as (select kind, round(avg(auc), 6) as auc_mean from by_fold group by kind),
b as (select kind, round(avg((p - y) * (p - y)), 4) as brier from kinds group by kind),
best as (select case when max(auc_mean) filter (kind <> 'raw') > max(auc_mean) filter (kind = 'raw')
                     then (select kind from s where kind <> 'raw' order by auc_mean desc, kind limit 1) else 'raw' end as chosen from s)
select kind, auc_mean, brier, kind = chosen as chosen from s join b using (kind), best
""")
def calibration_choice(spark, sf):
    """M17 + M18 + M19: isotonic and sigmoid calibration of out-of-fold scores, each fitted
    without the fold it is applied to, against the raw scores: mean AUC over the folds,
    Brier score; a calibration is chosen only if its AUC beats the raw one."""
    oof, _ = stacked(spark, sf)
    raw = stored(oof.where("model = 'marks'").withColumn("p", F.round("p", PLACES)).drop("model"), "raw")
    kinds = stored(EN.cross_calibrated(raw, "target", K).withColumn("p", F.round("p", PLACES)), "calibrated")
    auc = cv_summary(roc_auc(kinds, "target", "p", ["kind", "fold"]), "auc", ["kind"]).select("kind", F.round("auc_mean", 6).alias("auc_mean"))
    error = F.col("p") - F.col("target")
    rep = stored(auc.join(kinds.groupBy("kind").agg(F.round(F.avg(error * error), 4).alias("brier")), "kind"), "report")
    means = {r["kind"]: r["auc_mean"] for r in rep.collect()}  # a row per kind
    best = max(sorted(EN.CALIBRATIONS), key=means.__getitem__)
    return rep.withColumn("chosen", F.col("kind") == F.lit(best if means[best] > means["raw"] else "raw"))
