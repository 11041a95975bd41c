"""Feature queries (P2–P17): fit on the labelled rows, apply to train and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import equal_width_bin_sql
from ..operators.features import V3_31, V5_22, EqualWidthBins, FeaturePlan, RobustScaler, feat_sql, poly2
from ..sources.tables import Tables
from . import docs
from .registry import query, rounded

RAW_NUM = ["A", "B", "D", "E", "F", "G", "H", "I"]
ORDERS_SPLIT = "1998-01-01"   # orders before this date are the fitting half


def _plan_frame(spark, sf, spec, test_fill="train_median"):
    t = Tables(spark, sf)
    tr, te = docs.tables(t)  # the text is read once, the plan's statistics read the written features
    tr = tr.drop("target")
    plan = FeaturePlan(numeric=RAW_NUM, spec=spec, test_fill=test_fill).fit(tr)
    cols = ["doc_id", "is_test"] + plan.output_columns
    a = plan.transform(tr).withColumn("is_test", F.lit(0)).select(*cols)
    b = plan.transform(te, is_test=True).withColumn("is_test", F.lit(1)).select(*cols)
    return rounded(a.unionByName(b))


def _plan_sql(spec, test_fill=None):
    te_med = "med_E" if test_fill is None else repr(float(test_fill))
    base = f"""
with tr as {docs.TRAIN_SQL}, te as {docs.TEST_SQL},
st as (select quantile_cont(E, 0.5) as med_E from tr),
raw as (select *, 0 as is_test from tr union all by name select *, 1 as is_test from te),
base as (select doc_id, is_test, case when C = '+' then 1 else 0 end as C, A, B, D,
                coalesce(cast(E as double), case when is_test = 1 then {te_med} else med_E end) as E, F, G, H, I,
                cast(E is null as integer) as E_missing from raw, st),
bst as (select min(A) as lo_A, max(A) as hi_A, min(G) as lo_G, max(G) as hi_G from base where is_test = 0)
select doc_id, is_test, C, round(A, 6) as A, round(B, 6) as B, round(D, 6) as D, round(E, 6) as E, F,
       round(G, 6) as G, round(H, 6) as H, round(I, 6) as I, E_missing"""
    feats = []
    for f in spec:
        e = feat_sql(f)
        feats.append(f"{e} as {f.name}" if f.kind == "bin" else f"round({e}, 6) as {f.name}")
    return base + ",\n       " + ",\n       ".join(feats) + "\nfrom base, bst"


@query("encode_impute_flag", _plan_sql(()))
def encode_impute_flag(spark, sf):
    """P2 binary encode, P3 missing flag, P4/P6 train-median fill (train ∪ test)."""
    return _plan_frame(spark, sf, ())


@query("encode_impute_const", _plan_sql((), test_fill=2.0))
def encode_impute_const(spark, sf):
    """P5: the constant-fill rule — train rows get the train median, test rows 2.0."""
    return _plan_frame(spark, sf, (), test_fill=2.0)


@query("feature_plan_22", _plan_sql(V5_22))
def feature_plan_22(spark, sf):
    """The conservative 22-column plan."""
    return _plan_frame(spark, sf, V5_22)


@query("feature_plan_31", _plan_sql(V3_31))
def feature_plan_31(spark, sf):
    """The 31-column plan (interactions, squares, logs, ratios, sums,
    magnitude, equal-width bins fitted on train)."""
    return _plan_frame(spark, sf, V3_31)


@query("equal_width_bins", f"""
with st as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders
            where o_orderdate < timestamp '{ORDERS_SPLIT}')
select o_orderkey, cast(o_orderdate < timestamp '{ORDERS_SPLIT}' as integer) as is_train,
       cast({equal_width_bin_sql('o_totalprice', 'lo', 'hi', 5)} as integer) as price_bin
from orders, st
""")
def equal_width_bins(spark, sf):
    """5 equal-width bins of o_totalprice fitted on the early half."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    train = o.where(F.col("o_orderdate") < F.lit(ORDERS_SPLIT).cast("timestamp_ntz"))
    b = EqualWidthBins("o_totalprice", 5).fit(train)
    return b.transform(o, "price_bin").select(
        "o_orderkey", (F.col("o_orderdate") < F.lit(ORDERS_SPLIT).cast("timestamp_ntz")).cast("int").alias("is_train"),
        "price_bin")


@query("robust_scale", f"""
with st as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as q2,
                   quantile_cont(o_totalprice, 0.75) as q3 from orders where o_orderdate < timestamp '{ORDERS_SPLIT}')
select o_orderkey, round((o_totalprice - q2) / (case when q3 > q1 then q3 - q1 else 1.0 end), 6) as o_totalprice
from orders, st
""")
def robust_scale(spark, sf):
    """(x - median) / IQR with exact quartiles fitted on the early half."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    train = o.where(F.col("o_orderdate") < F.lit(ORDERS_SPLIT).cast("timestamp_ntz"))
    rs = RobustScaler(["o_totalprice"]).fit(train)
    return rounded(rs.transform(o.select("o_orderkey", "o_totalprice")))


@query("poly2_features", """
select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount,
       round(l_tax, 6) as l_tax,
       round(l_quantity * l_quantity, 6) as l_quantity_l_quantity, round(l_quantity * l_discount, 6) as l_quantity_l_discount,
       round(l_quantity * l_tax, 6) as l_quantity_l_tax, round(l_discount * l_discount, 6) as l_discount_l_discount,
       round(l_discount * l_tax, 6) as l_discount_l_tax, round(l_tax * l_tax, 6) as l_tax_l_tax
from lineitem
""")
def poly2_features(spark, sf):
    """Named degree-2 expansion over three lineitem columns."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(poly2(li, ["l_quantity", "l_discount", "l_tax"]))
