"""Blend, vote, weight-search and calibration queries.

Three "models" score every labelled document: min-max normalised punctuation
ratio (B), upper-case ratio (A) and 1 − type-token ratio (G), the
normalisation fitted on the labelled rows; predictions are kept LONG
``(doc_id, target, model, p)``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import ensemble as EN
from ..operators import boosting as B
from ..operators import validate as V
from ..operators.concurrent import at_once
from ..operators.metrics import cv_summary, roc_auc
from ..operators.util import stored
from ..sources.tables import Tables
from . import docs
from ..operators.search import Range, study
from .registry import query, rounded

MODELS = ["punct", "upper", "repeat"]
SOURCES = {"punct": "B", "upper": "A", "repeat": "G_inv"}
N_CAND = 200


def long_preds(spark, sf):
    tr = stored(docs.train_table(Tables(spark, sf)).withColumn("G_inv", 1 - F.col("G")).select(
        "doc_id", "target", *SOURCES.values()), "features")
    cols = list(SOURCES.values())
    mm = tr.agg(*[e for c in cols for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    parts = None
    for m, c in SOURCES.items():
        lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
        p = tr.select("doc_id", "target", F.lit(m).alias("model"),
                      ((F.col(c) - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)).alias("p"))
        parts = p if parts is None else parts.unionByName(p)   # U2: stack per-model tables
    return parts


PREDS_SQL = f"""
tr as {docs.TRAIN_SQL},
t2 as (select *, 1 - G as G_inv from tr),
mm as (select min(B) as lo_B, max(B) as hi_B, min(A) as lo_A, max(A) as hi_A, min(G_inv) as lo_G, max(G_inv) as hi_G from t2),
preds as (
  select doc_id, target, 'punct' as model, (B - lo_B) / (case when hi_B > lo_B then hi_B - lo_B else 1.0 end) as p from t2, mm
  union all select doc_id, target, 'upper', (A - lo_A) / (case when hi_A > lo_A then hi_A - lo_A else 1.0 end) from t2, mm
  union all select doc_id, target, 'repeat', (G_inv - lo_G) / (case when hi_G > lo_G then hi_G - lo_G else 1.0 end) from t2, mm)
"""


def _auc_cte(name, src, g, score="p", label="target"):
    return f"""
{name}_s as (select {g}, {score} as score, sum({label}) as pos, sum(1 - {label}) as neg from {src} group by all),
{name}_c as (select *, coalesce(sum(neg) over (partition by {g} order by score
               rows between unbounded preceding and 1 preceding), 0) as nb from {name}_s),
{name} as (select {g}, case when sum(pos) > 0 and sum(neg) > 0
                   then sum(pos * (2 * nb + neg)) / (2.0 * sum(pos) * sum(neg)) else null end as auc
           from {name}_c group by all)"""


@query("hard_vote", f"""
with {PREDS_SQL}
select doc_id, cast(round_even(avg(case when p > 0.5 then 1.0 else 0.0 end), 0) as integer) as vote
from preds group by doc_id
""")
def hard_vote(spark, sf):
    """Majority vote of the three models' 0/1 classes."""
    return EN.hard_vote(long_preds(spark, sf), "doc_id")


@query("weighted_blend", f"""
with {PREDS_SQL}, {_auc_cte('w', 'preds', 'model')},
b as (select doc_id, sum(w.auc * p) / sum(w.auc) as p from preds join w using (model) group by doc_id)
select doc_id, round(p, 6) as p from b
""")
def weighted_blend(spark, sf):
    """M21 + J1: AUC-weighted blend Σw·p/Σw (weights = each model's AUC)."""
    pr = stored(long_preds(spark, sf), "preds")
    w = roc_auc(pr, "target", "p", ["model"]).select("model", F.col("auc").alias("w"))
    return rounded(EN.weighted_blend(pr, w, "doc_id"))


@query("mean_blend", f"""
with {PREDS_SQL}
select doc_id, round(avg(p), 6) as p_mean, round(avg(p) filter (where model <> 'repeat'), 6) as p_mean_ex
from preds group by doc_id
""")
def mean_blend(spark, sf):
    """M22 + P26: plain mean blend, and the same without one model."""
    pr = long_preds(spark, sf)
    a = EN.mean_blend(pr, "doc_id", out="p_mean")
    b = EN.mean_blend(pr, "doc_id", exclude=["repeat"], out="p_mean_ex")
    return rounded(a.join(b, "doc_id"))


CAND_SQL = f"""
cand as (select c.range as cand, m.model,
           cast(('0x' || substr(md5('42:' || cast(c.range as varchar) || ':' || m.model), 1, 8))::ubigint as double)
             / {float(16 ** 8)} as w
         from range(0, {N_CAND}) c, (values ('punct'), ('upper'), ('repeat')) m(model)),
tot as (select cand, sum(w) as wsum from cand group by cand),
bl as (select cand, doc_id, target, round(sum(w * p) / sum(w), 12) as score
       from preds join cand using (model) group by cand, doc_id, target),
{_auc_cte('ca', 'bl', 'cand', score='score')},
sc as (select tot.cand, case when wsum > 0 then ca.auc else 0.0 end as auc from tot left join ca using (cand))
"""


@query("blend_search", f"""
with {PREDS_SQL}, {CAND_SQL}
select cand, round(auc, 6) as auc from sc
""")
def blend_search(spark, sf):
    """200 md5-seeded weight vectors scored by exact blend AUC in one grouped pass."""
    s = EN.blend_search(long_preds(spark, sf), "doc_id", "target", MODELS, N_CAND, 42)
    return rounded(s)


@query("blend_best", f"""
with {PREDS_SQL}, {CAND_SQL}
select arg_max(cand, (auc, -cand)) as cand, round(max(auc), 6) as auc from sc
""")
def blend_best(spark, sf):
    """M23 + A17: the winning candidate (max AUC, ties → lowest id)."""
    s = EN.blend_race(long_preds(spark, sf), "doc_id", "target", MODELS, EN.candidate_weights(spark, MODELS, N_CAND, 42))
    return rounded(EN.best_candidate(s))


@query("blend_study_start", f"""
with {PREDS_SQL}, {CAND_SQL}
select cast(cand as integer) as trial, round(auc, 6) as auc from sc where cand < 10
""")
def blend_study_start(spark, sf):
    """The trials that a study of blend weights starts from."""
    return rounded(blend_trials(spark, sf, 10).select("trial", "auc"))


@query("blend_study")
def blend_study(spark, sf):
    """A guided study of 200 weight vectors, in batches, with the exact AUC of each."""
    return rounded(blend_trials(spark, sf, 200))


def blend_trials(spark, sf, n):
    preds = stored(long_preds(spark, sf), "predictions")
    drawn = {}
    for r in EN.candidate_weights(spark, MODELS, 10, 42).collect():
        drawn.setdefault(r["cand"], {})[r["model"]] = r["w"]

    def evaluate(batch):
        cw = spark.createDataFrame([(i, m, float(w[m])) for i, w in enumerate(batch) for m in MODELS], "cand long, model string, w double")
        got = {r["cand"]: r["auc"] for r in EN.blend_search(preds, "doc_id", "target", MODELS, candidates=cw).collect()}
        return [got[i] for i in range(len(batch))]
    trials = study({m: Range(0.0, 1.0) for m in MODELS}, evaluate, n, batch=38, first=[drawn[i] for i in range(10)])
    rows = [(i, *(float(v[m]) for m in MODELS), a) for i, (v, a) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"w_{m} double" for m in MODELS) + ", auc double")


@query("isotonic_calibration", f"""
with {PREDS_SQL},
g as (select model, p, count(*) as n, sum(target) as pos, row_number() over (partition by model order by p) as i
      from preds group by model, p),
c as (select *, sum(n) over w as cn, sum(pos) over w as cp from g window w as (partition by model order by i)),
ab as (select a.model, a.i as a, b.i as b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) as m
       from c a join c b on a.model = b.model and a.i <= b.i),
lo as (select model, a, b, min(m) over (partition by model, a order by b desc) as mn from ab),
cal as (select model, b as i, max(mn) as calibrated from lo group by model, b)
select doc_id, model, round(calibrated, 6) as calibrated from preds join g using (model, p) join cal using (model, i)
""")
def isotonic_calibration(spark, sf):
    """Isotonic calibration of each model's scores as they are (oracle: the
    max–min formula of the least-squares fit)."""
    pr = stored(long_preds(spark, sf), "preds")
    parts = []
    for m in MODELS:
        own = pr.where(F.col("model") == m)
        parts.append(EN.isotonic_apply(EN.isotonic_fit(own, "p", "target"), own, "p", "calibrated"))
    return rounded(V.union(parts).select("doc_id", "model", "calibrated"))


@query("platt_calibration", f"""
with recursive {PREDS_SQL},
n as (select model, sum(target) as np, count(*) - sum(target) as nn from preds group by model),
d as (select model, p, case when target = 1 then (np + 1) / (np + 2) else 1 / (nn + 2) end as t, count(*) as k
      from preds join n using (model) group by all),
nw(i, model, a, b) as (
  select 0, model, 0.0::double, 0.0::double from n
  union all
  select i + 1, model, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (select i, model, a, b, sum(k * (q - t) * p) as g1, sum(k * (q - t)) as g2, sum(k * q * (1 - q) * p * p) as h11,
               sum(k * q * (1 - q) * p) as h12, sum(k * q * (1 - q)) as h22
        from (select nw.i, nw.model, a, b, p, t, k, 1 / (1 + exp(-(a * p + b))) as q from nw join d using (model) where nw.i < 25) x
        group by i, model, a, b) y)
select doc_id, model, round(1 / (1 + exp(-(a * p + b))), 4) as p_cal from preds join nw using (model) where i = 25
""")
def platt_calibration(spark, sf):
    """Sigmoid (Platt) calibration of each model's scores (oracle: Newton steps)."""
    pr = stored(long_preds(spark, sf), "preds")
    parts = []
    for m in MODELS:
        own = pr.where(F.col("model") == m)
        parts.append(EN.platt_apply(EN.platt_fit(own, "p", "target"), own, "p"))
    return V.union(parts).select("doc_id", "model", F.round("p_cal", 4).alias("p_cal"))


@query("pick_calibration")
def pick_calibration(spark, sf):
    """Isotonic and sigmoid calibration, cross-fitted three-fold inside every
    fitted set, against the raw model by five-fold CV AUC; calibration is chosen
    only if it beats the raw model. Test scores are those of the choice."""
    from dataclasses import replace

    from .q_models import clf_setup
    s, raw = clf_setup(spark, sf), B.PRESETS["lgb_v5"]
    three = {"raw": raw, "isotonic": replace(raw, calibrate="isotonic"), "sigmoid": replace(raw, calibrate="sigmoid")}
    oof, models = V.out_of_fold(s, three)
    rep = stored(cv_summary(roc_auc(oof, "target", "p", ["model", "fold"]), "auc", ["model"]), "report")
    auc = {r["model"]: r["auc_mean"] for r in rep.collect()}
    best = max(("isotonic", "sigmoid"), key=auc.__getitem__)
    chosen = best if auc[best] > auc["raw"] else "raw"
    test = V.test_scores(s, models).groupBy("model").agg(F.avg("p").alias("test_mean"), F.min("p").alias("test_min"),
                                                         F.max("p").alias("test_max"))
    return rounded(rep.join(test, "model").withColumn("chosen", F.col("model") == F.lit(chosen)))


@query("blend_oof")
def blend_oof(spark, sf):
    """M23 on fitted models: out-of-fold predictions of five models; AUC-weighted
    baseline, 200 candidates with refinement, and the AUC of weights searched
    without the fold they are applied to."""
    from .q_models import FIVE, clf_setup
    names = list(FIVE)
    oof, _ = V.out_of_fold(clf_setup(spark, sf), FIVE)
    auc = {r["model"]: r["auc"] for r in roc_auc(oof, "target", "p", ["model"]).collect()}

    def search(rows):
        cw = EN.candidate_weights(spark, names, N_CAND)
        table = EN.race_table(rows, "doc_id", "target", names)
        top = EN.best_candidate(EN.blend_race(rows, "doc_id", "target", names, cw, table=table)).first()["cand"]
        start = {r["model"]: r["w"] for r in cw.where(F.col("cand") == top).collect()}
        return EN.refine(rows, "doc_id", "target", names, start, table=table)

    def blended(rows, w):
        table = spark.createDataFrame([(m, float(w[m])) for m in names], "model string, w double")
        return EN.weighted_blend(rows, table, "doc_id")
    searches = at_once(spark, {"all": partial(search, oof), **{str(f): partial(search, oof.where(F.col("fold") != f)) for f in range(5)}})
    best, found = searches["all"]
    labels = oof.where(F.col("model") == names[0]).select("doc_id", "target", "fold")
    nested = V.union([blended(oof.where(F.col("fold") == f), searches[str(f)][0]) for f in range(5)])
    rows = [("cv_weighted", *(auc[m] / sum(auc.values()) for m in names),
             roc_auc(blended(oof, auc).join(labels, "doc_id"), "target", "p").first()["auc"]),
            ("optimised", *(best[m] / sum(best.values()) for m in names), found),
            ("nested", *([None] * len(names)), roc_auc(nested.join(labels, "doc_id"), "target", "p").first()["auc"])]
    return rounded(spark.createDataFrame(rows, "blend string, " + ", ".join(f"w_{m} double" for m in names) + ", auc double"))
