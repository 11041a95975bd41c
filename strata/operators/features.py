"""Fitted feature plans: statistics are fitted once on the training table
(one aggregate + exact quantiles, collected as a small dict) and applied as a
pure projection anywhere — train, test, or a streaming DataFrame.

A plan is declared as data (``FeatureSpec`` entries); ``sql_exprs`` renders the
same spec as SQL for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Feat:
    name: str
    kind: str          # mul | square | log1p | ratio | sum | mean | mag | bin
    args: tuple = ()


def _mul(a, b):
    return Feat(f"{a}_{b}", "mul", (a, b))


def _sq(a):
    return Feat(f"{a}_squared", "square", (a,))


# fixed values: the two engineered feature sets (22 and 31 columns)
V5_22 = (
    _mul("A", "E"), _mul("A", "G"), _mul("A", "H"), _mul("G", "H"),
    _sq("A"), _sq("G"), _sq("H"),
    Feat("log_A", "log1p", ("A", 0.0, False)), Feat("log_G", "log1p", ("G", 10.0, False)),
    Feat("A_D_ratio", "ratio", ("A", "D", 0.001, False)), Feat("G_I_ratio", "ratio", ("G", "I", 1.0, True)),
    Feat("sum_GHI", "sum", ("G", "H", "I")),
)
V3_31 = (
    _mul("A", "E"), _mul("A", "G"), _mul("A", "H"), _mul("E", "G"), _mul("E", "H"), _mul("G", "H"),
    _sq("A"), _sq("G"), _sq("H"), _sq("I"),
    Feat("log_A", "log1p", ("A", 0.0, False)), Feat("log_G", "log1p", ("G", 10.0, False)),
    Feat("log_I", "log1p", ("I", 10.0, False)),
    Feat("A_D_ratio", "ratio", ("A", "D", 0.001, False)), Feat("G_I_ratio", "ratio", ("G", "I", 10.0, False)),
    Feat("H_I_ratio", "ratio", ("H", "I", 10.0, False)),
    Feat("sum_GHI", "sum", ("G", "H", "I")), Feat("mean_GHI", "mean", ("G", "H", "I")),
    Feat("magnitude_HI", "mag", ("H", "I")),
    Feat("A_bin", "bin", ("A", 5)), Feat("G_bin", "bin", ("G", 5)),
)


def feat_expr(f: Feat, stats: dict) -> Column:
    a = f.args
    if f.kind == "mul":
        return F.col(a[0]) * F.col(a[1])
    if f.kind == "square":
        return F.col(a[0]) * F.col(a[0])
    if f.kind == "log1p":
        return C.log1p_shift(a[0], a[1], a[2])
    if f.kind == "ratio":
        return C.ratio(a[0], a[1], a[2], a[3])
    if f.kind == "sum":
        return C.row_sum(a)
    if f.kind == "mean":
        return C.row_mean(a)
    if f.kind == "mag":
        return C.magnitude(a[0], a[1])
    if f.kind == "bin":
        lo, hi = stats["bins"][a[0]]
        return C.equal_width_bin(a[0], lo, hi, a[1])
    raise ValueError(f.kind)


def feat_sql(f: Feat) -> str:
    """SQL text of one feature; bins read ``lo_<col>``/``hi_<col>`` from a stats row."""
    a = f.args
    if f.kind == "mul":
        return f"{a[0]} * {a[1]}"
    if f.kind == "square":
        return f"{a[0]} * {a[0]}"
    if f.kind == "log1p":
        x = f"abs({a[0]})" if a[2] else a[0]
        return f"ln(1 + ({x} + {a[1]}))"
    if f.kind == "ratio":
        d = f"abs({a[1]})" if a[3] else a[1]
        return f"{a[0]} / ({d} + {a[2]})"
    if f.kind == "sum":
        return " + ".join(a)
    if f.kind == "mean":
        return f"({' + '.join(a)}) / {float(len(a))}"
    if f.kind == "mag":
        return f"sqrt({a[0]} * {a[0]} + {a[1]} * {a[1]})"
    if f.kind == "bin":
        c, k = a
        return f"cast({C.equal_width_bin_sql(c, f'lo_{c}', f'hi_{c}', k)} as integer)"
    raise ValueError(f.kind)


@dataclass
class FeaturePlan:
    """Encode → missing flags → median fill (train medians) → engineered columns.

    ``test_fill`` = ``"train_median"`` (default) or a constant (the 2.0 rule).
    """
    numeric: list
    encode: dict = field(default_factory=lambda: {"C": "+"})
    flags: tuple = ("E",)
    spec: tuple = V5_22
    test_fill: object = "train_median"
    stats: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "FeaturePlan":
        nulls = train.agg(*[F.count(F.lit(1)) - F.count(c) for c in self.numeric]).first()
        fill_cols = [c for c, k in zip(self.numeric, nulls) if k > 0]
        med = exact_quantiles(train, fill_cols, [0.5]) if fill_cols else {}
        self.stats["median"] = {c: v[0] for c, v in med.items()}
        bin_cols = [f.args[0] for f in self.spec if f.kind == "bin"]
        if bin_cols:
            filled = self._base(train, self.stats["median"])
            mm = filled.agg(*[e for c in bin_cols for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
            self.stats["bins"] = {c: (float(mm[f"lo_{c}"]), float(mm[f"hi_{c}"])) for c in bin_cols}
        return self

    def fit_folds(self, train: DataFrame, k: int, fold_col: str = "fold") -> list["FeaturePlan"]:
        """One plan per fold, fitted without the fold's rows, and last the plan
        of all rows; the statistics of all of them come from common passes."""
        splits = range(k + 1)  # no fold has number k

        def outside(c, f):
            return F.when(~F.col(fold_col).eqNullSafe(F.lit(f)), F.col(c))
        wide = train.select(fold_col, *[outside(c, f).cast("double").alias(f"{c}__{f}") for c in self.numeric for f in splits])
        nulls = train.agg(*[F.count(F.lit(1)) - F.count(c) for c in self.numeric]).first()
        fill = [c for c, n in zip(self.numeric, nulls) if n > 0]
        med = exact_quantiles(wide, [f"{c}__{f}" for c in fill for f in splits], [0.5]) if fill else {}
        plans = [replace(self, stats={"median": {c: med[f"{c}__{f}"][0] for c in fill}}) for f in splits]
        bins = sorted({f.args[0] for f in self.spec if f.kind == "bin"})
        if bins:
            cells = [F.coalesce(F.col(f"{c}__{f}"), F.when(~F.col(fold_col).eqNullSafe(F.lit(f)),
                                                           F.lit(plans[f].stats["median"].get(c)).cast("double")))
                     for c in bins for f in splits]
            ends = wide.agg(*[e for x in cells for e in (F.min(x), F.max(x))]).first()
            at = iter(ends)
            for c in bins:
                for f in splits:
                    plans[f].stats.setdefault("bins", {})[c] = (float(next(at)), float(next(at)))
        return plans

    def _base(self, df: DataFrame, fills: dict) -> DataFrame:
        out = df
        for c, v in self.encode.items():
            out = out.withColumn(c, C.encode_binary(c, v))
        for c in self.flags:
            out = out.withColumn(f"{c}_missing", C.missing_flag(c))
        for c, v in fills.items():
            if v is not None:
                out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(v))))
        return out

    def transform(self, df: DataFrame, is_test: bool = False) -> DataFrame:
        fills = dict(self.stats.get("median", {}))
        if is_test and self.test_fill != "train_median":
            fills = {c: float(self.test_fill) for c in fills}
        base = self._base(df, fills)
        return base.select("*", *[feat_expr(f, self.stats).alias(f.name) for f in self.spec])

    @property
    def output_columns(self) -> list:
        return (list(self.encode) + [c for c in self.numeric if c not in self.encode]
                + [f"{c}_missing" for c in self.flags] + [f.name for f in self.spec])


def poly2(df: DataFrame, cols, keep: bool = True) -> DataFrame:
    """Degree-2 expansion without bias, named ``a``, ``a_a``, ``a_b`` (i <= j)."""
    cols = list(cols)
    extra = [(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return df.select("*", *extra) if keep else df.select(*[F.col(c) for c in cols], *extra)


@dataclass
class RobustScaler:
    """(x - median) / IQR with exact quartiles fitted on train; IQR 0 → divide by 1."""
    cols: list
    stats: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "RobustScaler":
        q = exact_quantiles(train, self.cols, [0.25, 0.5, 0.75])
        self.stats = {c: (v[1], (v[2] - v[0]) if v[2] != v[0] else 1.0) for c, v in q.items()}
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.select("*", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{c}{suffix}")
                                for c, (m, s) in self.stats.items()]) if suffix else \
            df.select(*[((F.col(c) - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1])).alias(c)
                        if c in self.stats else F.col(c) for c in df.columns])


@dataclass
class EqualWidthBins:
    """Equal-width right-closed bins fitted on train min/max, applied with clipping."""
    col: str
    k: int = 5
    lo: float = 0.0
    hi: float = 0.0

    def fit(self, train: DataFrame) -> "EqualWidthBins":
        r = train.agg(F.min(self.col), F.max(self.col)).first()
        self.lo, self.hi = float(r[0]), float(r[1])
        return self

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return df.withColumn(out or f"{self.col}_bin", C.equal_width_bin(self.col, self.lo, self.hi, self.k))
