"""Flagship slice: documents ⋈ labels → features → stratified folds → per-fold
class balance and exact AUC of the punctuation-ratio feature."""

from __future__ import annotations

from ..operators.folds import kfold_stratified
from ..operators.metrics import roc_auc
from ..operators.util import stored
from ..sources.tables import Tables
from . import docs
from .registry import query, rounded

FOLD_SQL = f"""
  (select *, cast((row_number() over (partition by target
                   order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1) % 5 as integer) as fold
   from {docs.TRAIN_SQL} tr)
"""


def docs_folds(spark, sf, *features):
    """(doc_id, target, fold) and the features named of the labelled documents."""
    t = Tables(spark, sf)
    rows = docs.train_table(t).select("doc_id", "target", *features) if features else docs.targets(t)
    # written, as a range shuffle reads its input twice (once for the bounds) and the text is dear to read
    return kfold_stratified(stored(rows, "features"), 5, "target", "doc_id", 42)


@query("auc_by_fold", f"""
with f as {FOLD_SQL},
s as (select fold, B, sum(target) as pos, sum(1 - target) as neg from f group by fold, B),
c as (select *, coalesce(sum(neg) over (partition by fold order by B
          rows between unbounded preceding and 1 preceding), 0) as nb from s)
select fold, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
       round(sum(pos * (2 * nb + neg)) / (2.0 * sum(pos) * sum(neg)), 6) as auc
from c group by fold
""")
def auc_by_fold(spark, sf):
    return rounded(roc_auc(docs_folds(spark, sf, "B"), "target", "B", ["fold"]))
