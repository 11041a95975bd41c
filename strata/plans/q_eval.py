"""Folds (W2–W4), exact AUC (A8–A10, W8), gap/version reports (A11, A13,
P18–P20) and drift (U1, A12, P27, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import auc_points, encode_binary, equal_width_bin, equal_width_bin_sql, points_delta
from ..operators import drift as D
from ..operators import reports as RP
from ..operators.folds import kfold_contiguous, kfold_shuffled
from ..operators.metrics import roc_auc, roc_auc_counts
from ..operators.util import stored
from ..sources.tables import Tables
from . import docs
from .q_core import FOLD_SQL as DOC_FOLD_SQL
from .q_core import docs_folds
from .q_features import ORDERS_SPLIT
from .registry import query, rounded

AUC_SQL = """
  {name}_s as (select {gsel}, {score} as score, sum({pos}) as pos, sum({neg}) as neg from {src} group by all),
  {name}_c as (select *, coalesce(sum(neg) over (partition by {g} order by score
                 rows between unbounded preceding and 1 preceding), 0) as nb from {name}_s),
  {name} as (select {g}, sum(pos) as n_pos, sum(neg) as n_neg,
                    case when sum(pos) > 0 and sum(neg) > 0
                         then sum(pos * (2 * nb + neg)) / (2.0 * sum(pos) * sum(neg)) end as auc
             from {name}_c group by all)
"""


def auc_sql(name, src, score, pos, neg, g=None):
    """SQL twin of ``roc_auc_counts`` (window form, used only by the oracle)."""
    if g is None:
        return AUC_SQL.format(name=name, src=src, score=score, pos=pos, neg=neg, g="_g", gsel="0 as _g")
    return AUC_SQL.format(name=name, src=src, score=score, pos=pos, neg=neg, g=g, gsel=g)


# ---- folds ---------------------------------------------------------------------

@query("kfold_contiguous", """
select o_orderkey, cast(ntile(5) over (order by o_orderkey) - 1 as integer) as fold from orders
""")
def kfold_contiguous_q(spark, sf):
    """Unshuffled contiguous 5 folds (ntile sizes) over the order key."""
    o = Tables(spark, sf).orders.select("o_orderkey")
    return kfold_contiguous(o, 5, ["o_orderkey"])


@query("kfold_shuffled", """
select o_orderkey, cast((row_number() over (order by md5('42:' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 5
                        as integer) as fold from orders
""")
def kfold_shuffled_q(spark, sf):
    """Shuffled (md5-ordered, seed 42) 5 folds over all orders."""
    return kfold_shuffled(Tables(spark, sf).orders.select("o_orderkey"), 5, "o_orderkey", 42)


@query("kfold_stratified", f"""
select doc_id, target, fold from {DOC_FOLD_SQL} f
""")
def kfold_stratified_q(spark, sf):
    """Stratified shuffled 5 folds of the labelled documents."""
    return docs_folds(spark, sf).select("doc_id", "target", "fold")


# ---- AUC -----------------------------------------------------------------------

@query("roc_auc_global", """
with s as (select l_extendedprice as score, sum(case when l_returnflag = 'R' then 1 else 0 end) as pos,
                  sum(case when l_returnflag = 'R' then 0 else 1 end) as neg from lineitem group by 1),
c as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as nb from s)
select cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
       round(sum(pos * (2 * nb + neg)) / (2.0 * sum(pos) * sum(neg)), 6) as auc from c
""")
def roc_auc_global(spark, sf):
    """Exact AUC of the extended price for the 'R' return flag over all lineitems."""
    li = Tables(spark, sf).lineitem.select("l_extendedprice", "l_returnflag")
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    return rounded(roc_auc(li.select(y, "l_extendedprice"), "y", "l_extendedprice"))


@query("auc_foldmean_vs_pooled", f"""
with f as {DOC_FOLD_SQL},
{auc_sql('pf', 'f', 'B', 'target', '1 - target', 'fold')},
{auc_sql('pp', 'f', 'B', 'target', '1 - target')}
select round(avg(pf.auc), 6) as auc_fold_mean, round(stddev_pop(pf.auc), 6) as auc_fold_std,
       round(max(pp.auc), 6) as auc_pooled,
       round((max(pp.auc) - avg(pf.auc)) * 100 / 0.08, 6) as points_delta
from pf, pp
""")
def auc_foldmean_vs_pooled(spark, sf):
    """A10 + P19: mean of per-fold AUCs vs the pooled AUC, and the points delta."""
    f = stored(docs_folds(spark, sf, "B").select("target", "fold", "B"), "folds")
    per = roc_auc(f, "target", "B", ["fold"]).agg(F.avg("auc").alias("auc_fold_mean"),
                                                   F.stddev_pop("auc").alias("auc_fold_std")).first()
    pooled = roc_auc(f, "target", "B").first()["auc"]
    out = spark.createDataFrame([(per[0], per[1], pooled)], "auc_fold_mean double, auc_fold_std double, auc_pooled double")
    return rounded(out.withColumn("points_delta", points_delta(F.col("auc_pooled") - F.col("auc_fold_mean"))))


# ---- gap / version report over binned target-rate models ----------------------

GAP_FEATURES = docs.FEATURES  # C as 0/1, a missing E as 0
GAP_BINS = 10


def bin_rate_scores(spark, sf):
    """Per feature, a 10-bin target-rate model: cross-fitted rates (fold k scored by
    the rates of the other folds) and in-sample rates, as aggregated
    ``(feature, fold, rate, pos, neg)`` rows."""
    f = stored(docs_folds(spark, sf, *docs.FEATURES).withColumn("C", encode_binary("C", "+")).withColumn("E", F.coalesce("E", F.lit(0))), "folds")
    mm = f.agg(*[e for c in GAP_FEATURES for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    wide = f.select("target", "fold", *[equal_width_bin(c, mm[f"lo_{c}"], mm[f"hi_{c}"], GAP_BINS).alias(c)
                                       for c in GAP_FEATURES])
    stack = ", ".join(f"'{c}', `{c}`" for c in GAP_FEATURES)
    long = wide.selectExpr("target", "fold", f"stack({len(GAP_FEATURES)}, {stack}) as (feature, bin)")
    cnt = long.groupBy("feature", "fold", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("pos"))
    cnt = stored(cnt, "counts")
    tot = cnt.groupBy("feature", "bin").agg(F.sum("n").alias("n_all"), F.sum("pos").alias("p_all"))
    ftot = cnt.groupBy("feature", "fold").agg(F.sum("n").alias("nf"), F.sum("pos").alias("pf"))
    alltot = cnt.groupBy("feature").agg(F.sum("n").alias("NN"), F.sum("pos").alias("PP"))
    rk = (cnt.join(tot, ["feature", "bin"]).join(ftot, ["feature", "fold"]).join(alltot, ["feature"])
          .select("feature", "fold", "bin", "pos", (F.col("n") - F.col("pos")).alias("neg"),
                  F.when(F.col("n_all") - F.col("n") > 0, (F.col("p_all") - F.col("pos")) / (F.col("n_all") - F.col("n")))
                   .otherwise((F.col("PP") - F.col("pf")) / (F.col("NN") - F.col("nf"))).alias("rate")))
    insample = tot.select("feature", (F.col("p_all") / F.col("n_all")).alias("rate"), F.col("p_all").alias("pos"),
                          (F.col("n_all") - F.col("p_all")).alias("neg"))
    return rk, insample


GAP_SQL = f"""
with f0 as {DOC_FOLD_SQL},
f as (select * replace (cast(C = '+' as integer) as C, coalesce(E, 0) as E) from f0),
mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in GAP_FEATURES)} from f),
b as (select target, fold, {', '.join(
    f"cast({equal_width_bin_sql(c, f'lo_{c}', f'hi_{c}', GAP_BINS)} as integer) as {c}"
    for c in GAP_FEATURES)} from f, mm),
long as (unpivot b on {', '.join(GAP_FEATURES)} into name feature value bin),
cnt as (select feature, fold, bin, count(*) as n, sum(target) as pos from long group by all),
tot as (select feature, bin, sum(n) as N, sum(pos) as P from cnt group by all),
ftot as (select feature, fold, sum(n) as nf, sum(pos) as pf from cnt group by all),
alltot as (select feature, sum(n) as NN, sum(pos) as PP from cnt group by all),
rk as (select c.feature, c.fold, c.bin, c.pos, c.n - c.pos as neg,
              case when t.N - c.n > 0 then (t.P - c.pos) / (t.N - c.n) else (a.PP - ft.pf) / (a.NN - ft.nf) end as rate
       from cnt c join tot t using (feature, bin) join ftot ft using (feature, fold) join alltot a using (feature)),
ins as (select feature, P / N as rate, P as pos, N - P as neg from tot),
{auc_sql('fa', 'rk', 'rate', 'pos', 'neg', 'feature, fold')},
{auc_sql('pa', 'rk', 'rate', 'pos', 'neg', 'feature')},
{auc_sql('ta', 'ins', 'rate', 'pos', 'neg', 'feature')},
cv as (select feature, avg(auc) as cv_auc from fa group by feature),
r as (select feature, ta.auc as train_auc, cv.cv_auc, pa.auc as oof_auc, ta.auc - cv.cv_auc as gap
      from cv join ta using (feature) join pa using (feature)),
r2 as (select *, 100 * least(greatest((cv_auc - 0.8) / 0.08, 0), 1) as expected_points,
              100 * least(greatest((oof_auc - 0.8) / 0.08, 0), 1) as test_points from r)
select feature, round(train_auc, 6) as train_auc, round(cv_auc, 6) as cv_auc, round(oof_auc, 6) as oof_auc,
       round(gap, 6) as gap,
       case when gap < 0.05 then 'excellent' when gap < 0.10 then 'good' when gap < 0.12 then 'acceptable'
            when gap < 0.15 then 'problem' else 'severe' end as gap_band,
       case when gap < 0.10 then 'excellent' when gap < 0.12 then 'acceptable' else 'overfit' end as verdict,
       case when gap > 0.12 then 'high' else 'ok' end as gap_flag,
       round(expected_points, 6) as expected_points, round(test_points, 6) as test_points,
       round(test_points - expected_points, 6) as points_diff
from r2
"""


@query("gap_report", GAP_SQL)
def gap_report(spark, sf):
    """A11 + A13 + P18 + P20: train vs CV AUC of binned target-rate models per
    feature, gap bands, expected vs out-of-fold points."""
    rk, ins = bin_rate_scores(spark, sf)
    fa = roc_auc_counts(rk, "rate", "pos", "neg", ["feature", "fold"])
    cv = fa.groupBy("feature").agg(F.avg("auc").alias("cv_auc"))
    pa = roc_auc_counts(rk, "rate", "pos", "neg", ["feature"]).select("feature", F.col("auc").alias("oof_auc"))
    ta = roc_auc_counts(ins, "rate", "pos", "neg", ["feature"]).select("feature", F.col("auc").alias("train_auc"))
    r = cv.join(ta, "feature").join(pa, "feature")
    r = RP.gap_report(r).withColumn("test_points", auc_points(F.col("oof_auc")))
    r = RP.version_report(r)
    return rounded(r.select("feature", "train_auc", "cv_auc", "oof_auc", "gap", "gap_band", "verdict", "gap_flag",
                            "expected_points", "test_points", "points_diff"))


@query("gap_bands_join", GAP_SQL[:GAP_SQL.index("\nselect feature, round(train_auc")] + """
select feature, round(gap, 6) as gap,
       case when gap < 0.05 then 'excellent' when gap < 0.10 then 'good' when gap < 0.12 then 'acceptable'
            when gap < 0.15 then 'problem' else 'severe' end as gap_band
from r2
""")
def gap_bands_join(spark, sf):
    """The same gap bands as a broadcast range join against a thresholds table."""
    rk, ins = bin_rate_scores(spark, sf)
    fa = roc_auc_counts(rk, "rate", "pos", "neg", ["feature", "fold"])
    cv = fa.groupBy("feature").agg(F.avg("auc").alias("cv_auc"))
    ta = roc_auc_counts(ins, "rate", "pos", "neg", ["feature"]).select("feature", F.col("auc").alias("train_auc"))
    r = cv.join(ta, "feature").withColumn("gap", F.col("train_auc") - F.col("cv_auc"))
    t = RP.thresholds_table(spark, RP.GAP_BANDS, RP.GAP_BAND_TOP)
    return rounded(RP.range_lookup(r, "gap", t, "gap_band").select("feature", "gap", "gap_band"))


# ---- drift ---------------------------------------------------------------------

DRIFT_COLS = docs.FEATURES


@query("drift_table", f"""
with tr0 as {docs.TRAIN_SQL}, te0 as {docs.TEST_SQL},
tr as (select * replace (cast(C = '+' as integer) as C) from tr0), te as (select * replace (cast(C = '+' as integer) as C) from te0),
m as (select 'train' as s, {', '.join(f'avg({c}) as {c}' for c in DRIFT_COLS)} from tr
      union all select 'test', {', '.join(f'avg({c})' for c in DRIFT_COLS)} from te),
l as (unpivot m on {', '.join(DRIFT_COLS)} into name column_name value mean),
w as (select column_name, max(case when s = 'train' then mean end) as train_mean,
             max(case when s = 'test' then mean end) as test_mean from l group by column_name),
d as (select *, 100 * (test_mean - train_mean) / (abs(train_mean) + 1e-10) as diff_pct from w)
select column_name, round(train_mean, 6) as train_mean, round(test_mean, 6) as test_mean,
       round(diff_pct, 6) as diff_pct,
       case when abs(diff_pct) > 50 then 'severe' when abs(diff_pct) > 20 then 'warning' else 'ok' end as marker
from d
""")
def drift_table_q(spark, sf):
    """U1 + A12: labelled vs unlabelled document feature means."""
    train, test = (x.withColumn("C", encode_binary("C", "+")) for x in docs.tables(Tables(spark, sf)))
    return rounded(D.drift_table(train, test, DRIFT_COLS))


@query("drift_weights", f"""
with u as (select o_orderkey, o_orderpriority, cast(o_orderdate >= timestamp '{ORDERS_SPLIT}' as integer) as is_test
           from orders),
r as (select o_orderpriority, avg(is_test::double) as p from u group by 1),
tr as (select o_orderkey, p from u join r using (o_orderpriority) where is_test = 0)
select o_orderkey, round(p, 6) as p, round(p * p / (select avg(p * p) from tr), 6) as weight from tr
""")
def drift_weights_q(spark, sf):
    """P27 + W7: drift score P(test | priority) and weights p²/mean(p²) on train rows."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit(ORDERS_SPLIT).cast("timestamp_ntz")
    s = D.frequency_drift_score(o.where(~late).drop("o_orderdate"), o.where(late).drop("o_orderdate"),
                                ["o_orderpriority"])
    tr = s.where(F.col("is_test") == 0)
    return rounded(D.drift_weights(tr, "p").select("o_orderkey", "p", "weight"))


@query("drift_auc", f"""
with u as (select o_orderpriority, cast(o_orderdate >= timestamp '{ORDERS_SPLIT}' as integer) as is_test from orders),
r as (select o_orderpriority, avg(is_test::double) as p from u group by 1),
s as (select p, is_test from u join r using (o_orderpriority)),
{auc_sql('a', 's', 'p', 'is_test', '1 - is_test')}
select round(auc, 6) as auc,
       case when auc < 0.55 then 'similar' when auc < 0.65 then 'slight' when auc < 0.75 then 'notable'
            else 'severe' end as status,
       case when auc < 0.55 then 'none' when auc < 0.70 then 'regularise' else 'reweight' end as action
from a
""")
def drift_auc(spark, sf):
    """P20: adversarial AUC of the frequency drift score and its status/action ladders."""
    o = Tables(spark, sf).orders.select("o_orderpriority", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit(ORDERS_SPLIT).cast("timestamp_ntz")
    s = D.frequency_drift_score(o.where(~late).drop("o_orderdate"), o.where(late).drop("o_orderdate"),
                                ["o_orderpriority"])
    a = roc_auc(s, "is_test", "p")
    return rounded(a.select("auc", RP.drift_status(F.col("auc")).alias("status"),
                            RP.drift_action(F.col("auc")).alias("action")))
