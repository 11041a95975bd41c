"""Staged minimum-cost routes on lettered grids, for many routes at once.

A route starts at a cell and must visit, in order, one cell of each stop type;
moving costs the Manhattan distance. Stop types without a cell in the grid are
skipped; a route without a valid stop costs 0.

A stage is an exact L1 distance transform: the costs at the cells of one type
spread over the grid by a forward and a backward sweep along the rows, then
along the columns, and are read at the cells of the next type. That is linear in
the cells of the grid, however many cells the types have. The routes of a grid
are dealt into chunks of about ``STOPS`` stops, each of which meets one copy of
the grid; a route is followed ``SEGMENT`` stops at a time, and longer ones go on
in a next round from the costs written by the last, so no group is unbounded.

``nearest_cell`` makes the same sweeps with windows over a grid's columns and
rows, at the rows and columns that are asked for.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_in_groups
from .util import broadcast_if_small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

SEGMENT, STOPS = 65_536, 1_000_000


def cells_by_type(cells: DataFrame) -> DataFrame:
    """Per (grid, type): cell count and bounding box."""
    return cells.groupBy("grid_id", "type").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("r").alias("min_r"), F.max("r").alias("max_r"),
        F.min("c").alias("min_c"), F.max("c").alias("max_c"))


def valid_stops(stops: DataFrame, routes: DataFrame, cells: DataFrame) -> DataFrame:
    """Drop stops whose type has no cell in the route's grid, then
    renumber ``seq`` 1..k per route. Returns (route_id, grid_id, type, seq)."""
    kinds = stored(cells.select("grid_id", "type").distinct(), "kinds")
    s = stops.join(routes.select("route_id", "grid_id"), "route_id")
    kept = s.join(broadcast_if_small(kinds), ["grid_id", "type"], "left_semi")
    return rank_in_groups(kept, ["route_id"], ["seq"], "_seq").drop("seq").withColumnRenamed("_seq", "seq")


def nearest_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` (with grid_id, r, c, type) with the nearest cell of the
    type as (to_r, to_c, dist), ties to the smallest (r, c).

    Columns first: for every row asked and every column with a cell of the type,
    the nearest of these above and below. Rows then: the least of that plus the
    way along the row, which to the left orders like the sum less the column and
    to the right like the sum plus the column, so running minima find it. A grid
    with h rows and w columns makes at most h * w rows a type."""
    kind = ["grid_id", "type"]
    asked = stored(points.select(*kind, "r", "c").distinct(), "asked")
    there = stored(cells.select(*kind, "r", "c").distinct(), "there")
    spots = asked.select(*kind, "r").distinct().join(there.select(*kind, "c").distinct(), kind)
    column = there.withColumn("own", F.col("r")).unionByName(spots.withColumn("own", F.lit(None).cast(there.schema["r"].dataType)))
    by_row = Window.partitionBy(*kind, "c").orderBy("r")  # the cells of one column
    above = F.last("own", ignorenulls=True).over(by_row.rangeBetween(Window.unboundedPreceding, 0))
    below = F.first("own", ignorenulls=True).over(by_row.rangeBetween(0, Window.unboundedFollowing))

    def step(to):
        return F.when(to.isNotNull(), F.struct(F.abs(F.col("r") - to).cast("long").alias("d"), to.alias("to_r")))
    met = column.withColumn("up", step(above)).withColumn("down", step(below)).where("own is null").select(
        *kind, "r", "c", F.least("up", "down").alias("best"))
    row = met.select(*kind, "r", "c", F.col("best.d").alias("d"), F.col("best.to_r").alias("to_r")).unionByName(
        asked.select(*kind, "r", "c", F.lit(None).cast("long").alias("d"), F.lit(None).cast(there.schema["r"].dataType).alias("to_r")))
    by_column = Window.partitionBy(*kind, "r").orderBy("c")  # the cells of one row

    def least(way, window):
        key = F.when(F.col("d").isNotNull(), F.struct((F.col("d") + way).alias("k"), "to_r", F.col("c").alias("to_c")))
        return F.min(key).over(window)
    row = row.withColumn("left", least(-F.col("c"), by_column.rangeBetween(Window.unboundedPreceding, 0))) \
        .withColumn("right", least(F.col("c"), by_column.rangeBetween(0, Window.unboundedFollowing))).where("d is null")

    def reached(side, way):
        return F.when(F.col(side).isNotNull(), F.struct((F.col(f"{side}.k") + way).cast("long").alias("dist"),
                                                        F.col(f"{side}.to_r").alias("to_r"), F.col(f"{side}.to_c").alias("to_c")))
    best = row.select(*kind, "r", "c", F.least(reached("left", F.col("c")), reached("right", -F.col("c"))).alias("best"))
    found = stored(best.where("best is not null").select(*kind, "r", "c", "best.to_r", "best.to_c", "best.dist"), "nearest")
    return points.join(broadcast_if_small(found), ["grid_id", "r", "c", "type"])


def sweep(cost, rows, columns):
    """Exact L1 distance transform of ``cost`` (least cost to reach each cell at
    first) of one grid or several, over sorted coordinates: two sweeps along either axis."""
    import numpy as np
    for axis, at in ((-1, columns[None, :]), (-2, rows[:, None])):
        ahead = np.minimum.accumulate(cost - at, axis=axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(cost + at, axis), axis=axis), axis) - at
        cost = np.minimum(ahead, back)
    return cost


#: A cost beyond all others; cells of the grids that are swept at once.
FAR, SWEPT = 1 << 60, 1 << 13


def followed(parts: pa.Table, cells: pa.Table) -> pa.Table:
    """(route_id, type, costs) after the types of each part, in the grid of
    ``cells``: the costs at the cells of the last type, by row and column. The
    routes that go from one type to another at the same stage go together."""
    import numpy as np
    r, c = (cells.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
    rows, i = np.unique(r, return_inverse=True)
    columns, j = np.unique(c, return_inverse=True)
    kinds: dict = {}
    for n, t in enumerate(cells.column("type").to_pylist()):
        kinds.setdefault(t, []).append(n)
    # cells of a type by (row, column); the same place twice is one cell
    at = [tuple(np.unique(np.stack([i[n], j[n]]), axis=1)) for n in kinds.values()]
    names, number = [*kinds, None], {t: n for n, t in enumerate(kinds)}
    begun = np.array([a is not None and b is not None for a, b in zip(*(parts.column(x).to_pylist() for x in ("sr", "sc")))], dtype=bool)
    sr, sc = (np.nan_to_num(parts.column(x).to_numpy()).astype(np.int64) for x in ("sr", "sc"))

    def reached(own, last, costs, kind):
        y, x = at[kind]
        if names[last] is None:  # from the start
            if not begun[own].all():
                raise ValueError("staged_route_cost: a route with stops has no start")
            return np.abs(rows[y] - sr[own, None]) + np.abs(columns[x] - sc[own, None])
        out, most = np.empty((len(own), len(y)), dtype=np.int64), max(1, SWEPT // (len(rows) * len(columns)))
        for n in range(0, len(own), most):
            grids = np.full((len(costs[n:n + most]), len(rows), len(columns)), FAR, dtype=np.int64)
            grids[:, at[last][0], at[last][1]] = costs[n:n + most]
            out[n:n + most] = sweep(grids, rows, columns)[:, y, x]
        return out

    # the stops with a cell, by number of the type, those of a route together
    listed = parts.column("types").to_pylist()
    stops = [[number[t] for t in types if t in number] for types in listed]
    count = np.array([len(x) for x in stops], dtype=np.int64)
    first, stop = np.cumsum(count) - count, np.array([t for x in stops for t in x], dtype=np.int64)
    before, known = parts.column("costs").to_pylist(), parts.column("last").to_pylist()
    by_last: dict = {}
    for n, (t, costs) in enumerate(zip(known, before)):
        by_last.setdefault((-1 if costs is None else number[t]), []).append(n)
    now = [(k, np.array(own), None if k < 0 else np.array([before[n] for n in own], dtype=np.int64)) for k, own in by_last.items()]
    out, stage = [], 0
    while now:
        following: dict = {}
        for last, own, costs in now:
            left = count[own] > stage
            if not left.all():
                out.append((own[~left], last, None if costs is None else costs[~left]))
            own, costs = own[left], None if costs is None else costs[left]
            kind = stop[first[own] + stage]
            for k in np.unique(kind):
                on = kind == k
                following.setdefault(int(k), []).append((own[on], reached(own[on], last, None if costs is None else costs[on], k)))
        now = [(k, *(np.concatenate(x) for x in zip(*got))) for k, got in following.items()]
        stage += 1
    ids, schema = parts.column("route_id"), parts.schema
    tables = [pa.table({"route_id": ids.take(pa.array(own)), "last": pa.array([names[last]] * len(own), schema.field("last").type),
                        "costs": pa.array([None] * len(own) if costs is None else costs.tolist(), pa.list_(pa.int64()))})
              for own, last, costs in out]
    return pa.concat_tables(tables) if tables else parts.select(["route_id", "last", "costs"])  # a grid without routes


def staged_route_cost(routes: DataFrame, stops: DataFrame, cells: DataFrame) -> DataFrame:
    """G1: minimum total travel per route, as (route_id, cost).

    routes ``(route_id, grid_id, sr, sc)`` (0-based start), stops ``(route_id,
    seq, type)`` with ``seq`` 1..k, cells ``(grid_id, r, c, type)``."""
    id_type, kind = routes.schema["route_id"].dataType.simpleString(), cells.schema["type"].dataType.simpleString()
    parts = stops.groupBy("route_id", F.floor((F.col("seq") - 1) / SEGMENT).cast("int").alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "type"))), lambda s: s["type"]).alias("types"))  # SEGMENT at most
    parts = stored(parts.join(routes.select("route_id", "grid_id", "sr", "sc"), "route_id"), "parts")
    chunks = parts.groupBy("grid_id").agg(F.ceil(F.sum(F.size("types")) / STOPS).cast("int").alias("chunks"))
    chunks = broadcast_if_small(stored(chunks, "chunks"))  # a row per grid
    grids = cells.select("grid_id", "r", "c", "type").join(chunks, "grid_id") \
        .select("grid_id", "r", "c", "type", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = parts.join(chunks, "grid_id").withColumn("chunk", F.pmod(F.xxhash64("route_id"), F.col("chunks")).cast("int"))
    longest = parts.agg(F.max("part")).first()[0]
    done = routes.select("route_id", F.lit(None).cast(kind).alias("last"), F.lit(None).cast("array<long>").alias("costs"))
    for n in range((longest if longest is not None else -1) + 1):  # one round for every SEGMENT stops of the longest route
        now = dealt.where(F.col("part") == n).join(done, "route_id").select(
            "grid_id", "chunk", "route_id", "types", F.col("sr").cast("long").alias("sr"), F.col("sc").cast("long").alias("sc"), "last", "costs")
        went = now.groupBy("grid_id", "chunk").cogroup(grids.groupBy("grid_id", "chunk")).applyInArrow(
            lambda part, grid: followed(part, grid), f"route_id {id_type}, last {kind}, costs array<bigint>")
        ended = done.join(parts.where(F.col("part") == n).select("route_id"), "route_id", "left_anti")
        done = stored(went.unionByName(ended), "routes")
    return done.select("route_id", F.coalesce(F.array_min("costs"), F.lit(0)).cast("long").alias("cost"))
