"""Exact quantiles (linear interpolation, as NumPy's and SQL's
``quantile_cont``) of many columns at once, without collecting a column.

The columns are stacked into (column, value) rows and counted, so a heavy value
is one row; running counts in value order (``ranking``) then say which value
holds each rank. One scan, one aggregate and one range shuffle serve all
columns and ranks, whatever the spread of the values. The driver gets two rows
per column and probability.

Null and NaN don't count as values; infinities do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_in_groups
from .util import stored


def exact_quantiles(df: DataFrame, cols, probs) -> dict[str, list[float | None]]:
    """``{col: [q(p) for p in probs]}``; None for a column without values."""
    cols = list(cols)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value"))
                                for i, c in enumerate(cols)]))
    counts = df.select(cells.alias("cell")).select("cell.*").where("value is not null and not isnan(value)") \
        .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    below = stored(prefix_in_groups(counts, ["col"], ["value"], ["n"]), "quantiles")
    sizes = {r["col"]: r["n"] for r in below.groupBy("col").agg(F.sum("n").alias("n")).collect()}
    places = {c: [(n - 1) * p for p in probs] for c, n in sizes.items()}
    ranks = sorted({(c, k) for c, ps in places.items() for p in ps for k in (math.floor(p), math.ceil(p))})
    wanted = F.broadcast(df.sparkSession.createDataFrame(ranks, "col int, rank long"))
    at = {(r["col"], r["rank"]): r["value"] for r in below.join(wanted, "col").where(
        "rank >= n_before and rank < n_before + n").select("col", "rank", "value").collect()}

    def value(c, p):
        low, high = at[c, math.floor(p)], at[c, math.ceil(p)]
        return low if low == high else low + (high - low) * (p - math.floor(p))
    return {name: [value(c, p) for p in places[c]] if c in places else [None for _ in probs]
            for c, name in enumerate(cols)}


def exact_medians(df: DataFrame, cols) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
