"""Profiling queries (A1–A5) over the classification table and driver tables."""

from __future__ import annotations


from ..operators import profile as P
from ..sources.tables import Tables
from . import docs
from .registry import query, rounded


@query("profile_train", f"""
with tr as {docs.TRAIN_SQL},
u as (unpivot (select count(*) as n, count(doc_id) as doc_id, count(A) as A, count(B) as B, count(C) as C,
        count(D) as D, count(E) as E, count(F) as F, count(G) as G, count(H) as H, count(I) as I,
        count(target) as target from tr)
      on doc_id, A, B, C, D, E, F, G, H, I, target into name column_name value non_null)
select column_name,
       case when column_name = 'doc_id' then 'bigint' when column_name = 'C' then 'string'
            when column_name in ('E', 'F', 'target') then 'int' else 'double' end as dtype,
       cast(list_position(['doc_id','A','B','C','D','E','F','G','H','I','target'], column_name) - 1 as integer) as position,
       n as n_rows, non_null, n - non_null as null_count
from u
""")
def profile_train(spark, sf):
    """A1: types, shape and null profile of the labelled feature table."""
    return P.profile(docs.train_table(Tables(spark, sf)))


@query("value_counts_lang", """
select lang, count(*) as count, round(count(*) / (select count(*) from documents)::double, 6) as fraction
from documents group by lang
""")
def value_counts_lang(spark, sf):
    """A2: value counts, plain and normalised."""
    return rounded(P.value_counts(Tables(spark, sf).documents, "lang", normalize=True))


@query("class_balance", f"""
with tr as {docs.TRAIN_SQL}
select count(*) as n, cast(sum(target) as bigint) as n_pos, cast(sum(1 - target) as bigint) as n_neg,
       round(sum(target) / count(*), 6) as pos_ratio,
       round(sum(1 - target) / sum(target), 6) as scale_pos_weight
from tr
""")
def class_balance(spark, sf):
    """A3: class balance of the labelled table."""
    return rounded(P.class_balance(docs.train_table(Tables(spark, sf)), "target"))


@query("class_weights", f"""
with tr as {docs.TRAIN_SQL}
select target, count(*) as n_class,
       round((select count(*) from tr) / (2.0 * count(*)), 6) as weight
from tr group by target
""")
def class_weights(spark, sf):
    """A4: 'balanced' class weights n / (k * n_c)."""
    return rounded(P.class_weights(docs.train_table(Tables(spark, sf)), "target"))


@query("column_stats", """
select column_name, n, round(min, 6) as min, round(max, 6) as max, round(mean, 6) as mean,
       round(median, 6) as median, round(std, 6) as std from (
  select 'o_totalprice' as column_name, count(o_totalprice) as n, min(o_totalprice) as min,
         max(o_totalprice) as max, avg(o_totalprice) as mean, quantile_cont(o_totalprice, 0.5) as median,
         stddev_pop(o_totalprice) as std from orders
  union all
  select 'o_custkey', count(o_custkey), min(o_custkey)::double, max(o_custkey)::double, avg(o_custkey),
         quantile_cont(o_custkey, 0.5)::double, stddev_pop(o_custkey) from orders
  union all
  select 'l_quantity', count(l_quantity), min(l_quantity), max(l_quantity), avg(l_quantity),
         quantile_cont(l_quantity, 0.5), stddev_pop(l_quantity) from lineitem)
""")
def column_stats(spark, sf):
    """A5: min, max, mean, exact median, population std."""
    t = Tables(spark, sf)
    a = P.column_stats(t.orders, ["o_totalprice", "o_custkey"])
    b = P.column_stats(t.lineitem, ["l_quantity"])
    return rounded(a.unionByName(b))
