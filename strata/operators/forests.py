"""Random forests (M5, M7) over all rows, many forests in shared passes: ``fit_cells``
for numbers on few features (one pass), ``fit_levels`` for labels 0 and 1 on many.

MLlib's forest goes over the rows once a level and adds up every node's
histogram in every task, for one forest at a time. Trees split on binned features
only, so with few features all that a tree needs of the rows are two sums for each
combination of bins (a cell): the drawn rows and their labels. One pass over
the rows draws every tree's bootstrap (Poisson, a draw per row and tree, as
MLlib's) and adds up the cells of all trees of all settings and splits; the tasks'
sums are added per tree by a shuffle, which also deals the trees over the
cluster to be grown (``boosting.grow``). A forest's prediction is a number per
cell. Work on rows is one pass whatever the depth; the rest doesn't grow with them.

Bins follow MLlib's rule on quantiles of all fitted rows; a split's bins are its own.
A row counts equally often in all the splits that it is fitted in.

Cases: a null or NaN label raises, as in MLlib; a null or NaN feature is in the
last bin; a split without rows raises.
"""

from __future__ import annotations

import json
import math
import sys
from dataclasses import asdict

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import boosting as B
from .util import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

#: Bins of a feature (MLlib's default), and the most cells that a tree's sums may have.
BINS, CELLS = 32, 1 << 16
#: Points of the quantile sketch that bins are taken from, and its accuracy.
POINTS, ACCURACY = 1000, 10_000
ROWS = 4096  # rows that are drawn for at a time


def cuts(sketch, bins: int):
    """At most ``bins`` - 1 thresholds between the values of a feature's quantiles: all that lie
    between values if these are few, else the nearest to equal shares."""
    import numpy as np
    values, n = np.unique(np.array([v for v in sketch or [] if v is not None and v == v], dtype=float), return_counts=True)
    if len(values) <= bins:
        return values[:-1] + np.diff(values) / 2
    below = np.cumsum(n)
    share = below[-1] / bins
    got, target = [], share
    for i in range(1, len(values)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            got.append(values[i - 1] + (values[i] - values[i - 1]) / 2)
            target += share
    return np.array(got[:bins - 1])


def quantiles(col, when=None):
    col = col.cast("double")
    probs = F.array(*[F.lit(i / (POINTS - 1)) for i in range(POINTS)])
    return F.percentile_approx(col if when is None else F.when(when, col), probs, F.lit(ACCURACY))


def cell_of(columns, edges):
    """The cell of every row, in the order of ``cell_bins``."""
    import numpy as np
    cell = np.zeros(len(columns[0]), dtype=np.int64)
    for x, e in zip(columns, edges):
        cell = cell * (len(e) + 1) + np.searchsorted(e, x, side="left")
    return cell


def cell_bins(edges):
    """(cells, features): the bins of every cell."""
    import numpy as np
    grid = np.meshgrid(*[np.arange(len(e) + 1, dtype=np.uint8) for e in edges], indexing="ij")
    return np.stack([g.ravel() for g in grid], axis=1)


def floats(col):
    """A batch's column as doubles, null as NaN."""
    import numpy as np
    return np.asarray(col.to_numpy(zero_copy_only=False), dtype=float)


def cell_sums(rows: DataFrame, features, label: str, settings: dict, edges: dict, held: dict) -> DataFrame:
    """(name, split, tree, n, s) per task: drawn rows and the sum of their labels by cell,
    as doubles. ``held``: the fold that a split isn't fitted on."""
    names, trees, seeds = list(settings), {n: s.trees for n, s in settings.items()}, {n: s.seed for n, s in settings.items()}
    cells = {f: len(cell_bins(e)) for f, e in edges.items()}
    wide = len(features)

    def run(batches):
        import numpy as np
        part = TaskContext.get().partitionId()
        rng = {n: np.random.default_rng([seeds[n], i, part]) for i, n in enumerate(names)}
        n_of = {(n, f): np.zeros((cells[f], trees[n])) for n in names for f in edges}
        s_of = {k: np.zeros_like(v) for k, v in n_of.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                columns = [floats(b.column(i)) for i in range(wide)]
                y, fold = floats(b.column(wide)), floats(b.column(wide + 1))
                groups = {}
                for f, e in edges.items():
                    use = np.flatnonzero(fold != held[f]) if held[f] is not None else np.arange(len(y))
                    if len(use):
                        cell = cell_of(columns, e)[use]
                        order = np.argsort(cell, kind="stable")
                        own, first = np.unique(cell[order], return_index=True)
                        groups[f] = use[order], own, first
                for n in names:
                    times = rng[n].poisson(1.0, (len(y), trees[n])).astype(float)
                    labels = times * y[:, None]
                    for f, (at, own, first) in groups.items():
                        n_of[n, f][own] += np.add.reduceat(times[at], first, axis=0)
                        s_of[n, f][own] += np.add.reduceat(labels[at], first, axis=0)
        for (n, f), v in n_of.items():
            t = trees[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * t), pa.array([f] * t, pa.int32()), pa.array(np.arange(t, dtype=np.int32)),
                 pa.array([c.tobytes() for c in v.T.copy()], pa.binary()), pa.array([c.tobytes() for c in s_of[n, f].T.copy()], pa.binary())],
                names=["name", "split", "tree", "n", "s"])
    return rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double"), F.col("fold").cast("double")) \
        .mapInArrow(run, "name string, split int, tree int, n binary, s binary")


def fit_cells(rows: DataFrame, features, label: str, settings: dict[str, B.Trees], held: dict[int, int | None]) -> dict:
    """(edges, prediction per cell) of every (name, split), fitted on the rows of
    a written table outside fold ``held[split]`` (None: on all)."""
    import numpy as np
    seen = {f: F.lit(True) if h is None else F.col("fold") != h for f, h in held.items()}
    bad = F.col(label).isNull() | F.isnan(F.col(label).cast("double"))
    got = rows.agg(F.count(F.when(bad, 1)).alias("bad"), *[F.count(F.when(seen[f], 1)).alias(f"n_{f}") for f in held],
                   *[quantiles(F.col(c), seen[f]).alias(f"q_{f}_{i}") for f in held for i, c in enumerate(features)]).first()
    if got["bad"] or not all(got[f"n_{f}"] for f in held):
        raise ValueError(f"{got['bad']} labels are null or NaN; rows fitted by split: { {f: got[f'n_{f}'] for f in held} }")
    edges = {f: [cuts(got[f"q_{f}_{i}"], BINS) for i in range(len(features))] for f in held}
    if max(int(np.prod([len(e) + 1 for e in es])) for es in edges.values()) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of bins: too many features")
    text = {n: json.dumps(asdict(s)) for n, s in settings.items()}

    def grown(table: pa.Table) -> pa.Table:
        name, split, tree = (table.column(c)[0].as_py() for c in ("name", "split", "tree"))
        n, s = (np.sum([np.frombuffer(v.as_py()) for v in table.column(c)], axis=0) for c in ("n", "s"))
        setting = B._setting(text[name])
        nodes, at = B.grow(cell_bins(edges[split]), -s, n, n > 0, setting, np.random.default_rng([setting.seed, tree]),
                           np.zeros(len(features)), rows=n)
        return pa.table({"name": [name], "split": pa.array([split], pa.int32()), "p": [np.array([t[3] for t in nodes])[at].tolist()]})
    trees = cell_sums(rows, features, label, settings, edges, held).groupBy("name", "split", "tree") \
        .applyInArrow(grown, "name string, split int, p array<double>")
    means = trees.select("name", "split", F.posexplode("p").alias("cell", "p")).groupBy("name", "split", "cell").agg(F.avg("p").alias("p"))
    out = {(n, f): (edges[f], np.zeros(len(cell_bins(edges[f])))) for n in settings for f in held}
    for r in means.collect():  # a number per cell of a forest, not per row
        out[r["name"], r["split"]][1][r["cell"]] = r["p"]
    return out


def score_cells(fitted: dict, name: str, split, features):
    """The predictions by forest ``name`` of the split that column ``split`` names."""
    own = {f: v for (n, f), v in fitted.items() if n == name}

    def run(split: pa.Array, *columns: pa.Array) -> pa.Array:
        import numpy as np
        at, x = floats(split), [floats(c) for c in columns]
        p = np.full(len(at), np.nan)
        for f, (edges, values) in own.items():
            i = np.flatnonzero(at == f)
            p[i] = values[cell_of([c[i] for c in x], edges)]
        return pa.array(p)
    return arrow_udf(run, returnType="double")(split.cast("double"), *[F.col(c).cast("double") for c in features])


# ---- classifiers on many features: a pass per level for all forests ---------------

#: Bins of a classifier's feature, rows of a block, trees of an output batch.
CLASS_BINS, BLOCK_ROWS, TREES_OUT = 64, 65_536, 25
HIST = "name string, split int, tree int, hist binary"


def asked(s: B.Trees, split: int, tree: int, level: int, nodes: int, wide: int):
    """The features that each node of a level may split on."""
    import numpy as np
    m = math.ceil(wide ** 0.5) if s.columns == "sqrt" else math.ceil(s.columns * wide)
    return np.random.default_rng([s.seed, split, tree, level]).random((nodes, wide)).argsort(axis=1)[:, :max(1, m)]


def histogram(x, y, own, times, nodes, level, ask):
    """Drawn rows by (node of the level, asked feature, bin, label). ``nodes``: rows of
    (feature, cut, left); the nodes of the level are the last ``level`` ones."""
    import numpy as np
    f, cut, left = nodes
    leaf, n = left < 0, x.shape[1]
    to, over, start = np.where(leaf, np.arange(len(f)), left), np.where(leaf, 255, cut), np.where(leaf, 0, f) * n
    flat, at = x.ravel(), np.zeros(len(own), dtype=np.int64)
    first, steps = len(f) - level, 0
    while (1 << steps) < len(f):  # a tree's levels, at most
        now = to[at] + (flat[start[at] + own] > over[at])
        if (now == at).all():
            break
        at, steps = now, steps + 1
    live = np.flatnonzero(at >= first)
    node, own, times = at[live] - first, own[live], times[live]
    m, label = ask.shape[1], y[own]
    out = np.empty((level, m, CLASS_BINS * 2), dtype=np.int32)
    base = node * (CLASS_BINS * 2) + label
    for j in range(m):
        cell = base + 2 * flat[ask[node, j] * n + own].astype(np.int64)
        out[:, j] = np.bincount(cell, times, level * CLASS_BINS * 2).reshape(level, -1)
    return out


def best_cuts(hist, s: B.Trees, weights):
    """Per node: asked feature, cut, gain (least gini, times the weight; -1: none), drawn rows of the left child and
    of the node by label."""
    import numpy as np
    n = hist.reshape(len(hist), -1, CLASS_BINS, 2).cumsum(axis=2).astype(float)
    total = n[:, :, -1:]
    rest = total - n

    def spread(c):
        a, b = c[..., 0] * weights[0], c[..., 1] * weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-300)
    ok = (n.sum(axis=-1) >= max(1, s.min_rows)) & (rest.sum(axis=-1) >= max(1, s.min_rows))
    gain = np.where(ok, spread(total) - spread(n) - spread(rest), -1.0).reshape(len(n), -1)
    best, each = gain.argmax(axis=1), np.arange(len(n))
    j, cut = np.divmod(best, CLASS_BINS)
    return np.column_stack([j, cut, gain[each, best], n[each, j, cut], total[:, 0, 0]])


def blocks(rows: DataFrame, edges: dict, most: int) -> DataFrame:
    """(split, block, x, y): bins by column and labels of the rows of a block, in the order of their
    keys, so that draws depend on the rows only. ``most``: rows of the largest split."""
    parts = max(1, -(-most // BLOCK_ROWS))

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.sort_by([("key", "ascending"), ("y", "ascending")]).combine_chunks()
        split, block = table.column("split")[0].as_py(), table.column("block")[0].as_py()
        x = table.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        binned = np.stack([np.searchsorted(e, x[:, i], side="left").astype(np.uint8) for i, e in enumerate(edges[split])])
        y = table.column("y").to_numpy().astype(np.uint8)
        return pa.table({"split": pa.array([split], pa.int32()), "block": pa.array([block], pa.int32()),
                         "x": pa.array([binned.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("key", "x"), F.lit(parts)).cast("int"))
    return stored(keyed.groupBy("split", "block").applyInArrow(pack, "split int, block int, x binary, y binary")
                  .repartition(min(400, parts * len(edges))), "blocks")


def fit_levels(frames: dict[int, DataFrame], settings: dict[str, B.Trees], key: str, label: str, features: str = "x") -> dict:
    """A model of ``boosting.predict`` per (name, split), fitted on all rows of the split's frame. A level of all trees
    of all forests is one pass: the tasks walk the trees so far and count the drawn rows of a block by node,
    feature, bin and label, a shuffle adds the blocks up per tree and chooses the cuts. The driver holds the trees.
    A bootstrap draws as many rows of a block as it has. Least rows are of drawn rows, impurity is gini, a node draws
    its features, leaves of the same class are merged and trees weigh the same, as in MLlib."""
    import numpy as np
    rows = None
    for split, df in frames.items():
        part = df.select(F.lit(split).alias("split"), F.col(key).cast("string").alias("key"), F.col(features).alias("x"),
                         F.col(label).cast("double").alias("y"))
        rows = part if rows is None else rows.unionByName(part)
    rows = stored(rows, "fit")
    head = rows.agg(F.max(F.size("x")).alias("wide"), F.count(F.when(F.col("y").isin(0.0, 1.0), None).otherwise(1)).alias("bad")).first()
    if head["bad"]:
        raise ValueError(f"{head['bad']} labels are neither 0 nor 1")
    wide = head["wide"] or 0
    got = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"),
                                    *[quantiles(F.col("x")[i]).alias(f"q{i}") for i in range(wide)]).collect()
    if {r["split"] for r in got} != set(frames):
        raise ValueError("a split has no rows")
    edges = {r["split"]: [cuts(r[f"q{i}"], CLASS_BINS) for i in range(wide)] for r in got}
    size, pos = ({r["split"]: r[c] for r in got} for c in ("n", "pos"))
    weights = {(n, f): (size[f] / (2.0 * max(size[f] - pos[f], 1)), size[f] / (2.0 * max(pos[f], 1))) if s.balanced else (1.0, 1.0)
               for n, s in settings.items() for f in frames}
    packed = blocks(rows, edges, max(size.values()))
    # per tree: (feature, cut, left) of its nodes, their values, its level's nodes, gain by node
    trees = {(n, f, t): [np.array([[-1], [0], [-1]]), np.zeros(1), 1, np.zeros(1)]
             for n, s in settings.items() for f in frames for t in range(s.trees)}
    for level in range(max(s.depth for s in settings.values())):
        now = {k: (v[0], v[2]) for k, v in trees.items() if v[2] and level < settings[k[0]].depth}
        if not now:
            break
        for r in one_level(packed, settings, now, weights, level, wide).collect():
            k = r["name"], r["split"], r["tree"]
            nodes, values, width, gains = trees[k]
            c0, c1 = weights[k[:2]]
            best = np.frombuffer(r["best"]).reshape(width, 7)
            left, total = best[:, 3:5] * (c0, c1), best[:, 5:7] * (c0, c1)
            if not level:
                values[0] = total[0, 1] / max(total[0].sum(), 1e-300)
            cut = np.flatnonzero(best[:, 2] > 1e-12 * total.sum(axis=1))
            j = best[cut, 0].astype(int)
            f = asked(settings[k[0]], k[1], k[2], level, width, wide)[cut, j]
            first = nodes.shape[1] - width
            grown = np.concatenate([nodes, np.tile([[-1], [0], [-1]], 2 * len(cut))], axis=1)
            grown[:, first + cut] = f, best[cut, 1], nodes.shape[1] + 2 * np.arange(len(cut))
            right = total[cut] - left[cut]
            both = np.stack([left[cut], right], axis=1).reshape(-1, 2)
            gains[first + cut] = best[cut, 2]
            trees[k] = [grown, np.concatenate([values, both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)]), 2 * len(cut),
                        np.concatenate([gains, np.zeros(2 * len(cut))])]
    out = {}
    for (n, f, t), (nodes, values, _, gains) in trees.items():
        m = out.setdefault((n, f), {"edges": edges[f], "trees": [], "importance": np.zeros(wide), "kind": "forest", "cols": None})
        merge(nodes, values)
        m["trees"].append(np.column_stack([nodes.T, values]))
        split = nodes[2] >= 0
        m["importance"] += np.bincount(nodes[0][split], gains[split], wide) / max(gains[split].sum(), 1e-300)  # trees count the same
    return {k: {**m, "importance": m["importance"].tolist()} for k, m in out.items()}


def merge(nodes, values) -> None:
    """Makes a leaf of every node whose children are leaves of the same class, as MLlib does."""
    left, high = nodes[2].tolist(), (values > 0.5).tolist()
    for i in range(len(left) - 1, -1, -1):  # a child has a higher number
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and high[a] == high[a + 1]:
            left[i] = nodes[2, i] = nodes[0, i] = -1


def one_level(packed: DataFrame, settings: dict, now: dict, weights: dict, level: int, wide: int) -> DataFrame:
    """(name, split, tree, best) of the trees in ``now``: (nodes, nodes of the level)."""
    of_split = {}
    for (n, f, t), (nodes, width) in now.items():
        of_split.setdefault(f, []).append((n, t, nodes, width))
    seeds = {n: i for i, n in enumerate(settings)}

    def count(batches):
        import numpy as np
        for batch in batches:
            for i in range(batch.num_rows):
                split, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                y = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint8)
                x = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8).reshape(-1, len(y))
                own_trees = of_split.get(split, [])
                for a in range(0, len(own_trees), TREES_OUT):
                    some, hists = own_trees[a:a + TREES_OUT], []
                    for n, t, nodes, width in some:
                        s = settings[n]
                        draws = np.random.default_rng([s.seed, seeds[n], split, t, block]).integers(0, len(y), len(y), dtype=np.int32)
                        times = np.bincount(draws, minlength=len(y))
                        own = np.flatnonzero(times)
                        hists.append(histogram(x, y, own, times[own], nodes, width, asked(s, split, t, level, width, wide)).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n for n, *_ in some]), pa.array([split] * len(some), pa.int32()),
                         pa.array([t for _, t, *_ in some], pa.int32()), pa.array(hists, pa.binary())], names=["name", "split", "tree", "hist"])

    def choose(table: pa.Table) -> pa.Table:
        import numpy as np
        name, split, tree = (table.column(c)[0].as_py() for c in ("name", "split", "tree"))
        width = now[name, split, tree][1]
        hist = sum(np.frombuffer(v.as_buffer(), dtype=np.int32).astype(np.int64) for v in table.column("hist"))
        best = best_cuts(hist.reshape(width, -1, CLASS_BINS * 2), settings[name], weights[name, split])
        return pa.table({"name": [name], "split": pa.array([split], pa.int32()), "tree": pa.array([tree], pa.int32()),
                         "best": pa.array([best.tobytes()], pa.binary())})
    return packed.mapInArrow(count, HIST).groupBy("name", "split", "tree").applyInArrow(choose, "name string, split int, tree int, best binary")
