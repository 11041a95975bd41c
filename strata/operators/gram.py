"""Linear models of all folds and penalties from one scan.

One aggregate gives each fold's count, means and covariances (Spark's own,
which merge partial results stably). The moments of the rows outside a fold are
those of all rows less the fold's, so every fit of a cross-validation, and the
error of every model on either side of every split, follow from the blocks
without another look at the rows. What reaches the driver is a row per fold with
a number per pair of columns.

Cases: rows with a null or NaN in a column used don't count. A fold without
rows has no error (None). Columns that depend on others get the solution of
least norm. An empty table gives no folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, means and population covariances of the features and, last, the label."""

    n: int
    mean: object
    cov: object

    def __sub__(self, part: "Moments") -> "Moments":
        """Moments of the rows that aren't in ``part``, a subset."""
        import numpy as np
        n = self.n - part.n
        if not n:
            return Moments(0, self.mean * 0, self.cov * 0)
        mean = (self.n * self.mean - part.n * part.mean) / n
        off = part.mean - mean
        cov = (self.n * self.cov - part.n * part.cov) / n - np.outer(off, off) * (part.n / self.n)
        return Moments(n, mean, cov)

    def __add__(self, other: "Moments") -> "Moments":
        import numpy as np
        n = self.n + other.n
        if not n:
            return self
        off = other.mean - self.mean
        mean = self.mean + off * (other.n / n)
        cov = (self.n * self.cov + other.n * other.cov) / n + np.outer(off, off) * (self.n * other.n / n / n)
        return Moments(n, mean, cov)


def fold_moments(df: DataFrame, features: list[str], label: str, fold: str = "fold") -> dict[int, Moments]:
    """Fold -> moments of its rows, by one aggregate."""
    import numpy as np
    cols = [*features, label]
    usable = F.lit(True)
    for c in cols:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = df.where(usable).groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs])
    out = {}
    for r in got.collect():  # a row per fold
        cov = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r[fold]] = Moments(r["n"], np.array([r[f"m{i}"] for i in range(len(cols))]), cov)
    return dict(sorted(out.items()))


def total(folds: dict[int, Moments]) -> Moments:
    all_rows = None
    for m in folds.values():
        all_rows = m if all_rows is None else all_rows + m
    return all_rows


def of(m: Moments, chosen: list[int]) -> Moments:
    """Moments of some of the features and the label."""
    import numpy as np
    at = np.array([*chosen, len(m.mean) - 1])
    return Moments(m.n, m.mean[at], m.cov[np.ix_(at, at)])


def ridge(m: Moments, alpha: float = 0.0):
    """(coefficients, intercept) of least squares with ``alpha * |b|^2`` on the sum of squares."""
    import numpy as np
    s, c = m.cov[:-1, :-1], m.cov[:-1, -1]
    b = np.linalg.lstsq(s + np.eye(len(c)) * (alpha / max(m.n, 1)), c, rcond=1e-13)[0]
    return b, float(m.mean[-1] - b @ m.mean[:-1])


def lasso(m: Moments, alpha: float, rounds: int = 10_000, tol: float = 1e-12):
    """(coefficients, intercept) under half the mean squared error plus
    ``alpha * |b|_1``: coordinate descent on the covariances."""
    import numpy as np
    s, c = m.cov[:-1, :-1], m.cov[:-1, -1]
    b = np.zeros(len(c))
    grad = c.copy()  # covariance of each feature with the residual
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            if s[j, j] <= 0:
                continue
            pull = grad[j] + s[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / s[j, j]
            if new != b[j]:
                grad -= s[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(s[j, j]))
                b[j] = new
        if moved <= tol * max(np.sqrt(m.cov[-1, -1]), 1e-300):
            break
    return b, float(m.mean[-1] - b @ m.mean[:-1])


def mse(m: Moments, model) -> float | None:
    """Mean squared error of (coefficients, intercept) on the rows of ``m``."""
    import numpy as np
    if not m.n:
        return None
    b, b0 = model
    v = np.append(-b, 1.0)
    return float(max(v @ m.cov @ v, 0.0) + (v @ m.mean - b0) ** 2)


def r2(m: Moments, model) -> float | None:
    if not m.n or m.cov[-1, -1] <= 0:
        return None
    return 1 - mse(m, model) / float(m.cov[-1, -1])


def cross_validated(folds: dict[int, Moments], fit) -> dict[int, tuple[Moments, Moments, tuple]]:
    """Fold -> (moments of the fitted rows, of the held-out rows, the model of the former)."""
    every = total(folds)
    out = {}
    for f, held in folds.items():
        seen = every - held
        if seen.n:
            out[f] = (seen, held, fit(seen))
    return out
