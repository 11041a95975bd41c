"""Boosted trees and forests with the full set of penalties (L1, L2, least gain,
least rows and weight per leaf, row and column shares, class weights), fitted
many at a time.

MLlib fits one model over all executors, with a job per level of every tree,
and has no leaf penalties. Model comparison is the other case: hundreds of fits
(settings x folds) on the same labelled tables. Here each fit is one task on all
rows of its table, which are a byte a feature by then: a job orders the rows by
their key and cuts them into columns, a column is a task that finds its bins
(exact quantiles of all rows), and a fit reads the bins of its split. Spark
deals the fits over the cluster, the costly ones first; a task holds some 200
bytes a row with 22 features, so rows per fit are bounded by a task's memory
and time, not by a number. Every row is scored by the fitted models where it
lies. All trees of a setting are grown, whatever their number.
"""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

#: Rows of a fit whose sums are made at a time, as many as stay in the cache; no result depends on it.
FIT_ROWS = 16_384
BINS = 64


@dataclass(frozen=True)
class Trees:
    """Settings of one tree model. ``columns`` is a share per tree or "sqrt" (per
    node); ``balanced`` weighs label 1 by negatives / positives; ``select`` fits
    on the features whose gain under that model is at least the median;
    ``squared`` fits a number by least squares instead of a probability;
    ``calibrate`` is "isotonic" or "sigmoid", cross-fitted three-fold."""

    trees: int
    depth: int
    step: float = 0.1
    rows: float = 1.0
    columns: float | str = 1.0
    min_rows: int = 1
    min_split: int = 2
    min_weight: float = 0.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    leaves: int = 1 << 30
    balanced: bool = False
    forest: bool = False
    squared: bool = False
    select: "Trees | None" = None
    calibrate: str | None = None
    seed: int = 42


# fixed values: the published settings of the boosted families and forests
PRESETS = {
    "xgb_v1": Trees(200, 6, 0.1, 0.8, 0.8, min_weight=1.0, l2=1.0),
    "xgb_v2": Trees(500, 8, 0.05, 0.8, 0.8, min_weight=3.0, min_gain=0.1, l1=0.1, l2=1.0, balanced=True),
    "xgb_v3": Trees(1000, 6, 0.03, 0.85, 0.85, min_weight=5.0, min_gain=0.05, l1=0.5, l2=2.0, balanced=True),
    "xgb_v4": Trees(500, 5, 0.05, min_weight=1.0, l1=1.0, l2=2.0, balanced=True),
    "xgb_v5": Trees(400, 4, 0.03, 0.7, 0.7, min_weight=10.0, min_gain=0.5, l1=2.0, l2=5.0, balanced=True),
    "lgb_v1": Trees(200, 6, 0.1, 0.8, 0.8, min_rows=20, leaves=31),
    "lgb_v2": Trees(500, 8, 0.05, 0.8, 0.8, min_rows=20, l1=0.1, l2=1.0, leaves=31, balanced=True),
    "lgb_v3": Trees(1000, 6, 0.03, 0.85, 0.85, min_rows=25, l1=0.5, l2=2.0, leaves=40, balanced=True),
    "lgb_v4": Trees(500, 5, 0.05, min_rows=20, l1=1.0, l2=2.0, leaves=31, balanced=True),
    "lgb_v5": Trees(400, 4, 0.03, 0.7, 0.7, min_rows=30, l1=2.0, l2=5.0, leaves=15, balanced=True),
    "lgb_weights": Trees(400, 4, 0.03, 0.7, 0.7, min_rows=30, l1=2.0, l2=5.0, leaves=31, balanced=True),
    "lgb_selector": Trees(200, 5, 0.1, min_rows=20, leaves=31, balanced=True),
    "lgb_adversarial": Trees(200, 4, 0.05, min_rows=20, leaves=31),
    "lgb_meta": Trees(100, 3, 0.05, min_rows=20, l1=1.0, l2=2.0, leaves=31, balanced=True),
    "catboost_v4": Trees(500, 5, 0.05, l2=3.0, balanced=True),
    "catboost_v5": Trees(400, 4, 0.03, l2=5.0, balanced=True),
    "gb_v3": Trees(500, 6, 0.05, 0.85, "sqrt", min_rows=10, min_split=20),
    "gb_weights": Trees(200, 4, 0.03, 0.7, "sqrt", min_rows=15, min_split=30),
    "rf_v1": Trees(200, 10, columns="sqrt", min_rows=2, min_split=5, forest=True),
    "rf_v2": Trees(500, 15, columns="sqrt", min_rows=4, min_split=10, balanced=True, forest=True),
    "rf_v3": Trees(700, 20, columns="sqrt", min_rows=5, min_split=15, balanced=True, forest=True),
    "rf_v4": Trees(300, 10, columns="sqrt", min_rows=10, min_split=20, balanced=True, forest=True),
    "rf_v5": Trees(300, 8, columns="sqrt", min_rows=15, min_split=30, balanced=True, forest=True),
    "rf_weights": Trees(200, 8, columns="sqrt", min_rows=15, min_split=30, balanced=True, forest=True),
}

# fixed values: the tree regressors of the regression study
REGRESSORS = {
    "Random Forest (100)": Trees(100, 10, forest=True, squared=True),
    "Random Forest (200)": Trees(200, 15, forest=True, squared=True),
    "Gradient Boosting": Trees(100, 3, 0.1, squared=True),
}

# fixed values: the three regularisation levels
REG_LEVELS = {
    "none": Trees(200, 10, 0.1, 1.0, 1.0, min_rows=5, leaves=31, balanced=True),
    "weak": Trees(400, 6, 0.05, 0.8, 0.8, min_rows=20, l1=0.5, l2=2.0, leaves=31, balanced=True),
    "strong": Trees(400, 4, 0.03, 0.7, 0.7, min_rows=30, l1=2.0, l2=5.0, leaves=31, balanced=True),
}


def grow(x, g, h, use, s: Trees, rng, gains, rows=None, same=None):
    """One tree over binned features ``x``, as (feature, cut, left, value) per node, and
    the leaf of every row, used or not; a row goes left where its bin is at most
    ``cut``; the right child is left + 1. Sums are made a feature at a time (``x`` is
    best stored by column), and only of features that a node may split on, in the rows'
    order. ``rows``: how many rows each of ``x`` stands for, if not one. ``same``: per
    feature the first one with the same bins; of such, the first asked always wins."""
    import numpy as np
    n_feat = x.shape[1]
    column = x.T.ravel()
    at = np.zeros(len(x), dtype=np.int64)
    live, node = np.arange(len(x)), at.copy()  # rows that may move on, and the node of each in ``level``
    tree = [[-1, 0, -1, 0.0]]
    level, leaves = [0], 1
    by_node = s.columns == "sqrt"
    # with a least weight, no child is empty
    counted = rows is not None or s.min_rows > 1 or s.min_split > 2 or not s.min_weight > 0

    def soft(a):
        return np.sign(a) * np.maximum(np.abs(a) - s.l1, 0.0)
    cols = np.arange(n_feat)
    if not by_node and s.columns < 1:
        cols = np.sort(rng.permutation(n_feat)[:max(1, round(s.columns * n_feat))])
    if same is not None and not by_node:
        cols = cols[np.sort(np.unique(same[cols], return_index=True)[1])]
    tree[0][3] = -float(soft(g[use].sum()) / max(h[use].sum() + s.l2, 1e-12))
    both = np.empty(len(x), dtype=complex)  # two sums in a pass
    both.real, both.imag = g, h
    every = use.all()
    for _ in range(s.depth):
        own, slot = (live, node) if every else (live[used := use[live]], node[used])
        if not level or not len(own):
            break
        if by_node:  # the features of each node
            pick = rng.random((len(level), n_feat)).argsort(axis=1) < max(1, int(n_feat ** 0.5))
            asked = np.nonzero(pick)[1].reshape(len(level), -1)
        else:
            asked = np.broadcast_to(cols, (len(level), len(cols)))
        shape = (len(level), asked.shape[1], BINS)
        sums, cl = np.zeros(shape, dtype=complex), np.zeros(shape, dtype=np.int64 if rows is None else float)
        flat, count = sums.ravel(), cl.ravel()
        for start in range(0, len(own), FIT_ROWS):
            some, of = own[start:start + FIT_ROWS], slot[start:start + FIT_ROWS]
            first, value = of * (shape[1] * BINS), both[some]
            number = np.ones(len(some), dtype=np.int64) if rows is None else rows[some]
            for j in range(shape[1]):
                cell = first + (column.take(asked[:, j].take(of) * len(x) + some) if by_node else x[:, cols[j]].take(some))
                np.add.at(flat[j * BINS:], cell, value)
                if counted:
                    np.add.at(count[j * BINS:], cell, number)
        gl, hl = sums.real.cumsum(axis=2), sums.imag.cumsum(axis=2)
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        ok = (hl >= s.min_weight) & (ht - hl >= s.min_weight)
        if counted:
            cl = cl.cumsum(axis=2)
            ct = cl[:, :, -1:]
            ok &= (cl >= s.min_rows) & (ct - cl >= s.min_rows) & (ct >= s.min_split)
        cuts = np.flatnonzero(ok)  # few in deep levels
        gw, hw, whole = gl.ravel()[cuts], hl.ravel()[cuts], cuts // BINS
        ga, ha = gt.ravel()[whole], ht.ravel()[whole]
        with np.errstate(divide="ignore", invalid="ignore"):
            got = soft(gw) ** 2 / (hw + s.l2) + soft(ga - gw) ** 2 / (ha - hw + s.l2) - soft(ga) ** 2 / (ha + s.l2)
        gain = np.full(ok.size, -1.0)
        gain[cuts] = np.where(np.isfinite(got), got, -1.0)
        gain = gain.reshape(len(level), -1)
        best = gain.argmax(axis=1)
        value = gain[np.arange(len(level)), best]
        nxt, went = [], np.tile([[0], [0], [-1]], len(level))
        for k in np.argsort(-value, kind="stable"):
            if value[k] <= max(s.min_gain, 1e-12) or leaves >= s.leaves:
                continue
            j, cut = divmod(int(best[k]), BINS)
            f = int(asked[k, j])
            gains[f] += value[k]
            left = len(tree)
            tree[level[k]][:3] = went[:, k] = [f, cut, left]
            own_n = (cl[k, j, cut], ct[k, j, 0] - cl[k, j, cut]) if counted else (np.inf, np.inf)
            for i, (gs, hs) in enumerate(((gl[k, j, cut], hl[k, j, cut]), (gt[k, j, 0] - gl[k, j, cut], ht[k, j, 0] - hl[k, j, cut]))):
                tree.append([-1, 0, -1, -float(soft(gs) / max(hs + s.l2, 1e-12))])
                # a node too small for two children isn't looked at again (where nodes draw features, it draws)
                if by_node or not (hs < 1.999999 * s.min_weight or own_n[i] < 0.999999 * max(2 * s.min_rows, s.min_split)):
                    nxt.append(left + i)
            leaves += 1
        f, cut, left = went
        if (left < 0).any():
            moved = np.flatnonzero(left[node] >= 0)
            live, node = live[moved], node[moved]
        now = left.take(node) + (column.take((f * len(x)).take(node) + live) > cut.take(node))
        at[live] = now
        place = np.full(len(tree), -1)
        place[nxt] = np.arange(len(nxt))
        node = place[now]
        if len(nxt) < 2 * (went[2] >= 0).sum():
            kept = node >= 0
            live, node = live[kept], node[kept]
        level = nxt
    return tree, at


def packed(model: dict) -> dict:
    """The model with its trees as flat arrays: feature, cut, left child and value of all nodes, then
    first node and steps by tree. A leaf leads to itself, so that all rows take as many steps as the deepest one."""
    import numpy as np
    if "parts" in model:
        return {**model, "parts": [(packed(m), *rest) for m, *rest in model["parts"]]}
    if "nodes" in model:
        return model
    trees = [np.asarray(t, dtype=float).reshape(-1, 4) for t in model["trees"]]
    first = np.cumsum([0, *[len(t) for t in trees]])
    nodes = np.concatenate([np.zeros((0, 4)), *trees])
    left = nodes[:, 2].astype(np.int64)
    leaf = left < 0
    left = np.where(leaf, np.arange(len(nodes)), left + np.repeat(first[:-1], np.diff(first)))
    depth = np.zeros(len(nodes), dtype=np.int64)
    while True:  # a level of all trees at a time
        up = np.zeros_like(depth)
        up[left[~leaf]] = up[left[~leaf] + 1] = depth[~leaf] + 1
        if (up == depth).all():
            break
        depth = up
    steps = np.maximum.reduceat(depth, first[:-1]) if len(trees) else depth[:0]
    flat = (np.where(leaf, 0, nodes[:, 0]).astype(np.int16), np.where(leaf, BINS, nodes[:, 1]).astype(np.uint8), left.astype(np.int32), nodes[:, 3])
    return {k: v for k, v in model.items() if k != "trees"} | {"nodes": flat, "first": first[:-1], "steps": steps}


def leaf_sums(x, model: dict):
    """The sum of the leaf values of all trees for every row of bins."""
    import numpy as np
    model = packed(model)
    f, cut, left, value = model["nodes"]
    left, total = left.astype(np.int64), np.zeros(len(x))
    for a in range(0, len(x), FIT_ROWS):
        some = x[a:a + FIT_ROWS]
        by_column, rows, start = some.T.ravel(), np.arange(len(some)), f.astype(np.int64) * len(some)
        for first, steps in zip(model["first"].tolist(), model["steps"].tolist()):
            at = np.full(len(some), first)
            for _ in range(steps):
                at = left.take(at) + (by_column.take(start.take(at) + rows) > cut.take(at))
            total[a:a + len(some)] += value.take(at)
    return total


def walk(x, tree):
    """Leaf values of one tree for all rows."""
    return leaf_sums(x, {"trees": [tree]})


def quantile_edges(x):
    """The upper ends of a column's bins but the last."""
    import numpy as np
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))[:BINS - 1]


def binned(x, edges):
    import numpy as np
    if not len(edges):
        return np.zeros((len(x), 0), dtype=np.uint8)
    # by column, in the type that holds a bin
    return np.stack([np.searchsorted(e, x[:, f], side="left").astype(np.uint8) for f, e in enumerate(edges)]).T


def sigmoid(z):
    import numpy as np
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x, y, w, s: Trees) -> dict:
    """A fitted model: bin edges, base score, trees, importances."""
    import numpy as np

    def table(rows=slice(None)):
        edges = [quantile_edges(x[rows, f]) for f in range(x.shape[1])]
        return binned(x, edges), edges
    parts = [table(fold != f) for fold in [thirds(y, s.seed)] for f in range(FOLDS)] if s.calibrate else []
    return fit_bins(table(), parts, y, w, s)


def fit_bins(whole, parts, y, w, s: Trees) -> dict:
    """``whole``: (bins, edges) of all rows; ``parts``: for a calibrated model the bins of all rows
    by the edges that are found without a third of them."""
    import numpy as np
    rng = np.random.default_rng(s.seed)
    if s.select is not None:
        kept = np.array(fit_bins(whole, [], y, w, s.select)["importance"])
        cols = np.flatnonzero(kept >= np.median(kept))
        whole, *parts = [(np.asfortranarray(b[:, cols]), [e[c] for c in cols]) for b, e in (whole, *parts)]
        return {**fit_bins(whole, parts, y, w, replace(s, select=None)), "cols": cols}
    if s.calibrate:
        return calibrated(parts, y, w, s)
    b, edges = whole
    if s.balanced:
        pos = w[y > 0].sum()
        w = np.where(y > 0, w * ((w.sum() - pos) / max(pos, 1e-12)), w)
    gains, trees = np.zeros(b.shape[1]), []
    same = np.array([next(j for j in range(f + 1) if (b[:, j] == b[:, f]).all()) for f in range(b.shape[1])])
    rate = min(max(float((w * y).sum() / w.sum()), 1e-6), 1 - 1e-6)
    if s.forest:
        for _ in range(s.trees):
            times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) * w
            trees.append(grow(b, -times * y, times, times > 0, s, rng, gains, same=same)[0])
        return {"edges": edges, "trees": trees, "importance": gains.tolist(), "kind": "forest", "cols": None}
    base = float((w * y).sum() / w.sum()) if s.squared else np.log(rate / (1 - rate))
    z = np.full(len(y), base)
    for _ in range(s.trees):
        p = z if s.squared else sigmoid(z)
        use = rng.random(len(y)) < s.rows if s.rows < 1 else np.ones(len(y), dtype=bool)
        tree, at = grow(b, w * (p - y), w if s.squared else w * np.maximum(p * (1 - p), 1e-16), use, s, rng, gains, same=same)
        for t in tree:
            t[3] *= s.step
        z += np.array([t[3] for t in tree])[at]
        trees.append(tree)
    return {"edges": edges, "trees": trees, "base": base, "importance": gains.tolist(),
            "kind": "squared" if s.squared else "boosted", "cols": None}


def predict(model: dict, x):
    """Probability of label 1 (a number for ``squared`` and for forests of numbers)."""
    import numpy as np
    if model["cols"] is not None:
        x = x[:, model["cols"]]
    if "parts" in model:
        return calibration_mean(model["parts"], [predict(m, x) for m, *_ in model["parts"]])
    return of_bins(model, binned(x, model["edges"]))


def of_bins(model: dict, b):
    """``predict`` for the bins of the model's features."""
    total = leaf_sums(b, model)
    if model["kind"] == "forest":
        return total / len(model["first"] if "first" in model else model["trees"])
    return model["base"] + total if model["kind"] == "squared" else sigmoid(model["base"] + total)


def calibration_mean(parts, raw):
    import numpy as np
    return np.mean([np.interp(p, *c) if kind == "isotonic" else sigmoid(c[0] * p + c[1]) for (_, c, kind), p in zip(parts, raw)], axis=0)


FOLDS = 3  # of a calibration


def thirds(y, seed: int):
    """The third of every row in a calibration, stratified by label."""
    import numpy as np
    rng = np.random.default_rng(seed)
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        i = np.flatnonzero(y == label)
        fold[rng.permutation(i)] = np.arange(len(i)) % FOLDS
    return fold


def calibrated(tables, y, w, s: Trees) -> dict:
    """Three models, each fitted without a third of the rows and calibrated on it."""
    import numpy as np
    fold = thirds(y, s.seed)
    parts, gains = [], 0
    for f, (b, edges) in enumerate(tables):
        fit, held = fold != f, fold == f
        m = packed(fit_bins((np.asfortranarray(b[fit]), edges), [], y[fit], w[fit], replace(s, calibrate=None)))
        p = of_bins(m, b[held])
        curve = corners(*isotonic(p, y[held])) if s.calibrate == "isotonic" else platt(p, y[held])
        parts.append((m, curve, s.calibrate))
        gains = gains + np.array(m["importance"])
    return {"parts": parts, "importance": gains.tolist(), "cols": None}


def corners(at, values):
    """The points that an interpolation needs: first and last of each step."""
    import numpy as np
    turn = np.flatnonzero(np.diff(values))
    keep = np.unique(np.concatenate([[0], turn, turn + 1, [len(at) - 1]])) if len(at) else slice(None)
    return at[keep], values[keep]


def isotonic(p, y):
    """Points of the increasing least-squares fit (pooled neighbours), for interpolation."""
    import numpy as np
    values, at = np.unique(p, return_inverse=True)
    n = np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for mean, weight in zip(np.bincount(at, y) / n, n):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m2, w2, c2), (m1, w1, c1) = blocks.pop(), blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, c1 + c2])
    return values, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def platt(p, y):
    """(slope, intercept) of a logistic curve with smoothed targets, by damped Newton steps."""
    import numpy as np
    pos = y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, beta = np.stack([p, np.ones_like(p)], axis=1), np.zeros(2)
    for _ in range(100):
        q = sigmoid(a @ beta)
        grad, hess = a.T @ (q - t), (a * (q * (1 - q))[:, None]).T @ a + 1e-10 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def _setting(text: str) -> Trees:
    d = json.loads(text)
    return Trees(**{**d, "select": Trees(**d["select"]) if d["select"] else None})


def cut_up(rows: DataFrame, paired: bool) -> DataFrame:
    """(split, part, place, v, y): the columns of (split, key, x, y, w) in the order of the keys, in pieces. A part is the
    number of a feature, "y" or "w". ``paired``: every piece of a feature comes with its labels."""
    ordered = rows.orderBy("split", F.asc_nulls_last("key"), F.asc_nulls_last("y"))

    def run(batches):
        import numpy as np
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            split = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)] if len(split) else [0]
            for start, end in zip(ends, ends[1:]):
                own = batch.slice(start, end - start)
                y, w = (np.asarray(own.column(i).to_numpy(zero_copy_only=False), dtype=float).tobytes() for i in (2, 3))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)
                x = np.nan_to_num(np.asarray(x, dtype=float)).T
                got = [*[(str(i), v.tobytes(), y if paired else None) for i, v in enumerate(x)], ("y", y, None), ("w", w, None)]
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(split[start])] * len(got), pa.int32()), pa.array([p for p, *_ in got]),
                     pa.array([task << 32 | n] * len(got), pa.int64()), pa.array([v for _, v, _ in got], pa.binary()),
                     pa.array([y for *_, y in got], pa.binary())], names=["split", "part", "place", "v", "y"])
    return ordered.select("split", "x", "y", "w").mapInArrow(run, "split int, part string, place long, v binary, y binary")


def columns(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """(split, part, edges, v) of whole columns: bins of features, a byte a row, by the quantiles of all rows of the split;
    labels and weights as doubles. For each of ``seeds`` (of calibrated models) the same by the rows without a third,
    named by ``third``: seed and third."""
    from .util import stored  # not at the top, as the module is sent to executors

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.sort_by("place")
        split, part = table.column("split")[0].as_py(), table.column("part")[0].as_py()
        v = np.frombuffer(b"".join(b.as_buffer() for b in table.column("v")))
        got = []
        if part in ("y", "w"):
            got.append(("", [], v.tobytes()))
        else:
            fits = [("", slice(None))]
            if seeds:
                y = np.frombuffer(b"".join(b.as_buffer() for b in table.column("y")))
                fits += [(f"{seed}/{f}", fold != f) for seed in seeds for fold in [thirds(y, seed)] for f in range(FOLDS)]
            for name, own in fits:
                edges = quantile_edges(v[own])
                got.append((name, edges.tolist(), np.searchsorted(edges, v, side="left").astype(np.uint8).tobytes()))
        return pa.table({"split": pa.array([split] * len(got), pa.int32()), "part": [part] * len(got), "third": [n for n, *_ in got],
                         "edges": pa.array([e for _, e, _ in got], pa.list_(pa.float64())), "v": pa.array([b for *_, b in got], pa.binary())})
    return stored(cut_up(rows, bool(seeds)).groupBy("split", "part").applyInArrow(
        run, "split int, part string, third string, edges array<double>, v binary"), "columns")


def cost(s: Trees) -> float:
    """How long a fit takes, against others on the same rows."""
    share = 0.4 if s.columns == "sqrt" else s.columns
    return s.trees * s.depth * s.rows * share * (2 if s.calibrate else 1) + (cost(s.select) if s.select else 0)


def fit_many(frames: dict[int, DataFrame], jobs: dict[str, Trees], key: str, label: str = "label",
             features: str = "x", weight: str | None = None) -> dict[tuple[str, int], dict]:
    """Fit every setting on all rows of every frame (split -> rows with an array of
    features): a model per (name, split). A fit is a task, one after the other by ``cost``."""
    import pickle
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = None
    for split, df in frames.items():
        part = df.select(F.lit(split).alias("split"), F.col(key).cast("string").alias("key"), F.col(features).alias("x"),
                         F.col(label).cast("double").alias("y"), w.alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    whole = columns(rows, sorted({s.seed for s in jobs.values() if s.calibrate}))
    fits = sorted(((n, f) for n in jobs for f in frames), key=lambda a: -cost(jobs[a[0]]))
    settings = [json.dumps(asdict(jobs[n])) for n, _ in fits]
    needs = [(i, f, third) for i, (n, f) in enumerate(fits)
             for third in ["", *([f"{jobs[n].seed}/{j}" for j in range(FOLDS)] if jobs[n].calibrate else [])]]

    def run(batches):
        import numpy as np
        fit, parts, one = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                fit, part, third = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                v = batch.column(4)[i].as_buffer()
                if part in ("y", "w"):
                    one[part] = np.frombuffer(v)
                else:
                    parts.setdefault(third, {})[int(part)] = np.frombuffer(v, dtype=np.uint8), batch.column(3)[i].values.to_numpy()
        if fit is None:  # no rows
            return
        tables = {}
        for third in sorted(parts):
            own = parts.pop(third)
            tables[third] = np.stack([own[f][0] for f in range(len(own))]).T, [own[f][1] for f in range(len(own))]
        model = fit_bins(tables.pop(""), [tables[t] for t in sorted(tables)], one["y"], one["w"], _setting(settings[fit]))
        yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([pickle.dumps(packed(model))], pa.binary())], names=["fit", "model"])
    wanted = rows.sparkSession.createDataFrame(needs, "fit int, split int, third string")
    got = whole.join(F.broadcast(wanted), ["split", "third"]).select("fit", "part", "third", "edges", "v") \
        .repartitionById(len(fits), F.col("fit")).mapInArrow(run, "fit int, model binary")
    return {fits[r["fit"]]: pickle.loads(r["model"]) for r in got.collect()}


def score_many(parts: list[tuple[int, DataFrame]], models: dict[tuple[str, int], dict], names: list[str], features: str = "x") -> DataFrame:
    """The rows of every (split, frame) times the models of the split: the frame's columns without
    ``features``, then split, model and p. A row is read once for all models."""
    models = {k: packed(m) for k, m in models.items() if k[0] in names}
    rows = None
    for split, df in parts:
        part = df.select(*[c for c in df.columns if c != features], F.lit(split).alias("split"), features)
        rows = part if rows is None else rows.unionByName(part)
    kept = rows.drop(features)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["model string", "p double"])

    def run(batches):
        import numpy as np
        for batch in batches:
            of = batch.column(batch.num_columns - 2).to_numpy()
            for split in np.unique(of).tolist():
                own = batch.filter(pa.array(of == split))
                x = own.column(own.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                x = np.nan_to_num(x)
                for name in names:
                    p = pa.array(predict(models[name, split], x))
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array([name] * own.num_rows, pa.string()), p],
                                                     names=[*own.schema.names[:-1], "model", "p"])
    return rows.mapInArrow(run, schema)


def score(features: Column, model: dict) -> Column:
    """Probability of label 1 for an array column of features."""
    model = packed(model)

    def run(col: pa.Array) -> pa.Array:
        import numpy as np
        if not len(col):
            return pa.array([], pa.float64())
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        return pa.array(predict(model, np.nan_to_num(x)))
    return arrow_udf(run, returnType="double")(features)
