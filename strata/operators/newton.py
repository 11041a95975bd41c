"""Many logistic regressions at once.

Every model of a call — a penalty and weight per setting, a held-out fold per
split — takes its Newton steps together: one pass over the rows gives the loss,
gradient and Hessian block of each at its own point, added up in the tasks and
then by an aggregate, and the driver solves systems of as many unknowns as there
are features. A step that doesn't lower the loss is halved. The number of passes
is that of the slowest model, a dozen as a rule, whatever the number of models.

The penalty is ``1 / C`` on half the squared coefficients, not the intercept,
against the loss summed over the rows (with weights that add up to the rows), as
in ``models.logistic``.

Cases: rows with a null label, weight or feature don't count. A model without
rows of both classes gets None.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

PASSES, TOL = 60, 1e-11


@dataclass(frozen=True)
class Logistic:
    """``c``: inverse penalty; ``held``: the fold that the fit doesn't see;
    ``balanced``: classes weigh the same in sum; ``columns``: places of the
    features that it reads (None: all)."""

    c: float
    held: int | None = None
    balanced: bool = False
    columns: tuple[int, ...] | None = None


def blocks(df: DataFrame, points: dict, weights: dict) -> dict:
    """name -> (loss, gradient, Hessian) at its point, from one pass over
    (x, y, fold). ``points`` has fold held out, columns and point, ``weights`` the
    weights of the two classes."""
    import numpy as np
    names = list(points)
    held, columns, at = ({n: points[n][i] for n in names} for i in range(3))
    size = {n: len(b) for n, b in at.items()}
    length = {n: 1 + d + d * d for n, d in size.items()}

    def run(batches):
        total = {n: np.zeros(length[n]) for n in names}
        for b in batches:
            if not b.num_rows:
                continue
            every = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            every = np.concatenate([every, np.ones((len(every), 1))], axis=1)
            y, fold = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            for n in names:
                use = np.ones(len(y), dtype=bool) if held[n] is None else fold != held[n]
                x = every[use] if columns[n] is None else every[use][:, [*columns[n], -1]]
                w = np.where(y[use] > 0, weights[n][1], weights[n][0])
                z = x @ at[n]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[n][0] += (w * (np.logaddexp(0, z) - y[use] * z)).sum()
                total[n][1:1 + size[n]] += x.T @ (w * (p - y[use]))
                total[n][1 + size[n]:] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [length[n] for n in names])),
             pa.array(np.concatenate([np.arange(length[n], dtype=np.int32) for n in names])), pa.array(np.concatenate([total[n] for n in names]))],
            names=["model", "place", "value"])
    got = df.mapInArrow(run, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect()
    out = {n: np.zeros(length[n]) for n in names}
    for r in got:  # numbers per model, not rows
        out[names[r["model"]]][r["place"]] = r["value"]
    return {n: (v[0], v[1:1 + size[n]], v[1 + size[n]:].reshape(size[n], size[n])) for n, v in out.items()}


def fit(df: DataFrame, models: dict[str, Logistic], label: str, x: str = "x", fold: str = "fold") -> dict:
    """name -> (coefficients, intercept) or None. ``df`` is a written table, as
    every pass reads it; ``fold`` may be missing if no model holds one out."""
    import numpy as np
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"),
                     (F.col(fold) if fold in df.columns else F.lit(-1)).cast("int").alias("fold")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    counts = {}
    for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect():  # folds and classes
        counts[r["fold"], r["y"]] = (r["n"], r["d"])
    every = max((d for _, d in counts.values()), default=0)
    size = {n: 1 + (every if m.columns is None else len(m.columns)) for n, m in models.items()}
    point, step, loss, weights, done = {}, {}, {}, {}, {}
    for n, m in models.items():
        neg, pos = (sum(c for (f, y), (c, _) in counts.items() if y == k and (m.held is None or f != m.held)) for k in (0, 1))
        if not pos or not neg:
            done[n] = None
            continue
        weights[n] = ((pos + neg) / (2 * neg), (pos + neg) / (2 * pos)) if m.balanced else (1.0, 1.0)
        point[n], step[n], loss[n] = np.zeros(size[n]), np.zeros(size[n]), np.inf
    pull = {n: np.append(np.full(size[n] - 1, 1 / m.c), 0.0) for n, m in models.items()}
    for _ in range(PASSES):
        if not point:
            break
        now = blocks(rows, {n: (models[n].held, models[n].columns, b) for n, b in point.items()}, weights)
        for n, (value, grad, hess) in now.items():
            b = point[n]
            value += 0.5 * float(pull[n] @ (b * b))
            if value > loss[n] + 1e-12 * abs(loss[n]):  # too far: half the way back
                step[n] = step[n] / 2
                point[n] = b - step[n]
            else:
                loss[n] = value
                step[n] = -np.linalg.solve(hess + np.diag(pull[n]) + 1e-12 * np.trace(hess) / size[n] * np.eye(size[n]), grad + pull[n] * b)
                point[n] = b + step[n]
            if np.abs(step[n]).max() <= TOL * max(1.0, np.abs(point[n]).max()):
                done[n] = (point[n][:-1], float(point[n][-1]))
        point = {n: b for n, b in point.items() if n not in done}
    for n, b in point.items():  # as near as the passes came
        done[n] = (b[:-1], float(b[-1]))
    return {n: done[n] for n in models}
