"""Exact k nearest neighbours of every row of a table among its other rows.

Equal points are one point with its ``k + 1`` smallest keys, which is all that
any neighbour list can use of them. Points are dealt into the cells of a k-d
tree, whose cuts come from a bounded sample (``SAMPLE`` points; the tree only
says where work is done, never what is found). Each point first meets the
points of its own cell (a chunk of it, if the cell is large), which bounds the
distance of its k-th neighbour. It then goes to every cell that reaches within
that bound, itself included, and returns its ``k + 1`` best of each; a window
per point merges them. A cell's points are cut into chunks of ``CHUNK`` and the
points that visit into chunks of ``VISITORS``, so no task holds a whole cell.

Squared distances are sums over the coordinates in their order, in double
precision, so equal on every path and in SQL; ties go to the smaller key.

Cases: rows with a null key, a null point or a null or non-finite coordinate
take no part. Keys are unique. With ``k`` or fewer other rows all of them are
neighbours. All points have one length. An empty table gives an empty result.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import broadcast_if_small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

SAMPLE, CELL, CHUNK, VISITORS = 16_384, 1024, 4096, 4096
FOUND = "point long, d2 double, key long"


def flat(column):
    import numpy as np
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squared(x, y):
    """Squared distances of all rows of x and y, coordinate after coordinate."""
    import numpy as np
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j][:, None] - y[:, j][None, :]) ** 2
    return out


def cuts(x, cells: int) -> list[tuple[int, float] | None]:
    """A k-d tree by place (root 1, children 2p and 2p + 1): (coordinate, cut)
    at the median of the widest coordinate, None at a cell. Places beyond the
    list are cells."""
    import numpy as np
    size = 1
    while size < cells:
        size *= 2
    tree: list[tuple[int, float] | None] = [None] * size
    work = [(1, x)]
    while work:
        place, rows = work.pop()
        if place >= size or len(rows) < 32:
            continue
        width = rows.max(axis=0) - rows.min(axis=0)
        j = int(width.argmax())
        cut = float(np.median(rows[:, j]))
        low = rows[:, j] <= cut
        if low.all() or not low.any():
            continue
        tree[place] = (j, cut)
        work += [(2 * place, rows[low]), (2 * place + 1, rows[~low])]
    return tree


def home(tree, x):
    """The cell of each row of x."""
    import numpy as np
    at = np.zeros(len(x), dtype=np.int64)
    work = [(1, np.arange(len(x)))]
    while work:
        place, rows = work.pop()
        node = tree[place] if place < len(tree) else None
        if node is None:
            at[rows] = place
            continue
        low = x[rows, node[0]] <= node[1]
        work += [(2 * place, rows[low]), (2 * place + 1, rows[~low])]
    return at


def reached(tree, x, bound):
    """(row, cell) of the cells within squared distance ``bound`` of each row of
    x. Beyond a cut the distance to the region grows by that to the cut, which
    replaces what its coordinate added before."""
    import numpy as np
    out = []
    work = [(1, np.arange(len(x)), np.zeros(x.shape))]
    while work:
        place, rows, off = work.pop()
        node = tree[place] if place < len(tree) else None
        if node is None:
            out.append((rows, np.full(len(rows), place)))
            continue
        j, cut = node
        for child, beyond in ((2 * place, x[rows, j] - cut), (2 * place + 1, cut - x[rows, j])):
            far = off.copy()
            far[:, j] = np.maximum(far[:, j], beyond)
            ok = (far * far).sum(axis=1) <= bound[rows] * (1 + 1e-9)
            if ok.any():
                work.append((child, rows[ok], far[ok]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def best_of(d, keys, counts, limit, k: int):
    """(row, d2, key): the ``k`` smallest (d2, key) of each row of ``d``, whose
    columns are points that have the next ``counts`` of ``keys``; only d2 up to ``limit``."""
    import numpy as np
    ends = np.cumsum(counts)
    rows, ds, ks = [], [], []
    for i in range(len(d)):
        near = np.flatnonzero(d[i] <= limit[i])
        if len(near) > k:  # points at the k-th distance all stay, as the keys decide
            near = near[d[i][near] <= np.partition(d[i][near], k - 1)[k - 1]]
        own = np.concatenate([keys[ends[j] - counts[j]:ends[j]] for j in near]) if len(near) else keys[:0]
        dist = np.repeat(d[i][near], counts[near])
        first = np.lexsort((own, dist))[:k]
        rows += [i] * len(first)
        ds.append(dist[first])
        ks.append(own[first])
    return np.array(rows, dtype=np.int64), np.concatenate(ds or [np.zeros(0)]), np.concatenate(ks or [keys[:0]])


def nearest(rows: DataFrame, k: int, key: str = "key", x: str = "x") -> DataFrame:
    """(key, nth from 1, neighbour, d2) for every row of ``rows``, written."""
    inf = F.lit(float("inf"))
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(x).cast("array<double>").alias("x")).where(
        F.col("key").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)))
    # adding zero makes one number of 0.0 and -0.0
    own = stored(own.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0))), "rows")
    first = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    classes = own.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    points = stored(classes.select(F.col("keys")[0].alias("point"), "x", "keys"), "points")
    n = points.count()
    if not n:
        return own.select("key", F.lit(1).alias("nth"), F.col("key").alias("neighbour"), F.lit(0.0).alias("d2")).limit(0)
    import numpy as np
    sample = np.array([r["x"] for r in points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("x").collect()])
    tree = cuts(sample, -(-n // CELL))

    def dealt(batches):
        for b in batches:
            at = home(tree, flat(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["point", "x", "keys", "cell"])
    index = stored(points.mapInArrow(dealt, "point long, x array<double>, keys array<long>, cell long"), "index")
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(sizes.select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "parts")
    index = index.join(broadcast_if_small(parts), "cell").withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))

    def bounded(table: pa.Table) -> pa.Table:
        """The distance that the k-th neighbour of each point has at most."""
        table = table.combine_chunks()
        at, lists = flat(table.column("x").combine_chunks()), table.column("keys").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        bound = np.full(len(at), np.inf)
        for s in range(0, len(at), 512):
            d = squared(at[s:s + 512], at)
            order = np.argsort(d, axis=1, kind="stable")
            have = np.cumsum(counts[order], axis=1) >= k + 1
            full = have.any(axis=1)
            last = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), have.argmax(axis=1)]
            bound[s:s + 512] = np.where(full, last, np.inf)
        return pa.table({"point": table.column("point"), "x": table.column("x"), "bound": pa.array(bound)})
    bounds = stored(index.groupBy("cell", "part").applyInArrow(bounded, "point long, x array<double>, bound double"), "bounds")

    def visits(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                own = b.slice(s, 1024)
                row, cell = reached(tree, flat(own.column(1)), own.column(2).to_numpy())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(at) for c in range(3)), pa.array(cell)],
                                                 names=["point", "x", "bound", "cell"])
    asked = stored(bounds.mapInArrow(visits, "point long, x array<double>, bound double, cell long"), "visits")
    turns = stored(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("turns"))
                   .join(parts, "cell"), "turns")

    def all_of(c):
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["cell", "part", "turn", "point", "x", "keys", "bound"]
    there = index.join(broadcast_if_small(turns.select("cell", "turns")), "cell").withColumn("turn", all_of("turns")) \
        .withColumn("bound", F.lit(None).cast("double"))
    asks = asked.join(broadcast_if_small(turns), "cell").withColumn("turn", F.pmod(F.xxhash64("point"), F.col("turns")).cast("int")) \
        .withColumn("part", all_of("parts")).withColumn("keys", F.lit(None).cast("array<long>"))

    def met(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        limit = table.column("bound").combine_chunks()
        asking = np.array(limit.is_valid())
        at, point = flat(table.column("x").combine_chunks()), table.column("point").to_numpy()
        lists = table.column("keys").combine_chunks().filter(pa.array(~asking))
        counts, keys = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        q, names, limits = at[asking], point[asking], limit.filter(pa.array(asking)).to_numpy()
        out = []
        for s in range(0, len(q), 512):
            d = squared(q[s:s + 512], at[~asking])
            row, d2, key = best_of(d, keys, counts, limits[s:s + 512], k + 1)
            out.append((names[s:s + 512][row], d2, key))
        names, d2, key = (np.concatenate(z) for z in zip(*out)) if out else (names[:0], limits[:0], keys[:0])
        return pa.table({"point": pa.array(names, pa.int64()), "d2": pa.array(d2, pa.float64()), "key": pa.array(key, pa.int64())})
    found = there.select(*cols).unionByName(asks.select(*cols)).groupBy("cell", "part", "turn").applyInArrow(met, FOUND)
    merged = Window.partitionBy("point").orderBy("d2", "key")
    found = stored(found.withColumn("n", F.row_number().over(merged)).where(F.col("n") <= k + 1)
                   .select("point", F.col("key").alias("neighbour"), "d2"), "near-points")
    lists = found.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("d2", "neighbour"))).alias("near"))  # k + 1 at most
    of_point = points.join(lists, "point").select(F.col("x").alias("at"), "near")
    others = F.slice(F.filter("near", lambda v: v["neighbour"] != F.col("key")), 1, k)
    each = own.join(of_point, F.col("x") == F.col("at")).select("key", F.posexplode(others).alias("nth", "near"))
    return stored(each.select("key", (F.col("nth") + 1).alias("nth"), F.col("near.neighbour").alias("neighbour"), F.col("near.d2").alias("d2")),
                  "neighbours")
