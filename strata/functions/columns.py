"""Scalar column functions: encoders, guarded arithmetic, ladders, geometry.

All of these return ``Column`` objects so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_binary(c, positive: str) -> Column:
    """1 where the value equals ``positive``; 0 otherwise, including NULL."""
    return F.coalesce((col(c) == F.lit(positive)).cast("int"), F.lit(0))


def missing_flag(c) -> Column:
    return col(c).isNull().cast("int")


def log1p_shift(c, shift: float = 0.0, absolute: bool = False) -> Column:
    """``log1p(x + shift)`` (or of ``abs(x)``); NULL where the argument <= -1."""
    x = F.abs(col(c)) if absolute else col(c)
    return F.log1p(x + F.lit(shift))


def ratio(num, den, eps: float = 0.0, abs_den: bool = False) -> Column:
    """Guarded ratio ``num / (den + eps)``; NULL instead of a divide-by-zero error."""
    d = F.abs(col(den)) if abs_den else col(den)
    return F.try_divide(col(num), d + F.lit(eps))


def row_sum(cols) -> Column:
    return reduce(add, [col(c) for c in cols])


def row_mean(cols) -> Column:
    return row_sum(cols) / F.lit(float(len(cols)))


def magnitude(a, b) -> Column:
    return F.sqrt(col(a) * col(a) + col(b) * col(b))


def bin_edges(lo: float, hi: float, k: int) -> list:
    """Interior edges ``lo + i * ((hi - lo) / k)``, i = 1..k-1 (NumPy ``linspace`` arithmetic)."""
    step = (hi - lo) / k
    return [i * step + lo for i in range(1, k)]


def equal_width_bin(c, lo: float, hi: float, k: int) -> Column:
    """Right-closed equal-width bin index 0..k-1 over [lo, hi]: the number of
    interior edges strictly below the value. Identical to pandas
    ``cut(x, k, labels=False)`` on the fitted range; outside values clip."""
    if hi <= lo:
        return F.when(col(c).isNotNull(), F.lit(0))
    return reduce(add, [(col(c) > F.lit(e)).cast("int") for e in bin_edges(lo, hi, k)])


def equal_width_bin_sql(c: str, lo: str, hi: str, k: int) -> str:
    """SQL twin of ``equal_width_bin`` with ``lo``/``hi`` as SQL expressions."""
    terms = " + ".join(f"cast({c} > {i} * (({hi} - {lo}) / {k}) + {lo} as integer)" for i in range(1, k))
    return f"(case when {hi} > {lo} then {terms} when {c} is not null then 0 end)"


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


# fixed values: the scoring rule maps AUC 0.80 -> 0 points and 0.88 -> 100 points
POINTS_FLOOR = 0.8
POINTS_SPAN = 0.08


def auc_points(c) -> Column:
    """100 * clip((auc - 0.8) / 0.08, 0, 1)."""
    return F.lit(100.0) * clip((col(c) - F.lit(POINTS_FLOOR)) / F.lit(POINTS_SPAN), 0.0, 1.0)


def points_delta(c) -> Column:
    """Points worth of an AUC change (no clipping)."""
    return col(c) * F.lit(100.0) / F.lit(POINTS_SPAN)


def ladder(c, bands, default=None, right_closed: bool = False) -> Column:
    """Status by range. ``bands`` is ``[(upper_bound, label), ...]`` ascending;
    the first band whose bound exceeds the value wins (``<=`` if right_closed)."""
    expr = None
    for bound, label in bands:
        cond = col(c) <= F.lit(bound) if right_closed else col(c) < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def manhattan(r1, c1, r2, c2) -> Column:
    return F.abs(col(r1) - col(r2)) + F.abs(col(c1) - col(c2))


def polar_angle(x0, y0, x1, y1) -> Column:
    """Angle of the vector (x0,y0)->(x1,y1), in (-pi, pi]."""
    return F.atan2(col(y1) - col(y0), col(x1) - col(x0))


def rel_angle(angle, ref) -> Column:
    """``angle - ref`` normalised into [0, 2*pi) for angle, ref in [-pi, pi]
    (one conditional turn either way, so in-range values are left untouched)."""
    a = col(angle) - col(ref)
    a = F.when(a < 0, a + F.lit(TWO_PI)).otherwise(a)
    return F.when(a >= F.lit(TWO_PI), a - F.lit(TWO_PI)).otherwise(a)


def prob_to_class(c, threshold: float = 0.5) -> Column:
    return (col(c) > F.lit(threshold)).cast("int")
