"""Tree and point-set operators, for many trees at once (keyed by ``tree_id``).

edges ``(tree_id, eid, u, v)`` — undirected, ``eid`` = input order, which is
also each vertex's adjacency (child) order; points ``(tree_id, point_id, x, y)``;
vertices and points 0-based.

* ``orient``         — root every tree: parents, depths and subtree sizes (A18) from Euler tours, by pointer jumping
* ``root_point``     — A15/G6: max y, then min x, then min id
* ``polar_rank``     — W5/G4/O4: angle around a pivot relative to a reference
* ``allocate``       — J6/W6: ranked items → consecutive capacity ranges
* ``centroids``      — A14
* ``embed``          — the whole embedding, one tree level per iteration
* ``segments``       — G7/J5: edges with their endpoints' coordinates

Ranks and running sums go through ``ranking``, so one vertex that owns a third
of all points (the root owns all of a tree's points) fills many partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import polar_angle, rel_angle

from .ranking import forward_fill, prefix_in_groups, rank_in_groups
from .util import broadcast_if_small, stored

DOWN = -math.pi / 2   # reference direction at the root (pointing down)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def successors(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree_id, arc, next): the Euler tour of every tree as a linked list. After
    the arc into a vertex comes the vertex's next arc out, in edge order and
    around; the list ends before the root's first arc. ``arcs`` is ranked."""
    number = (F.col("eid") * 2 + F.col("side")).cast("long")
    degree = arcs.groupBy("tree_id", "a").agg(F.count(F.lit(1)).alias("degree"))
    into = arcs.join(degree, ["tree_id", "a"]).select(  # the arc into ``a`` along the same edge, and what follows it
        "tree_id", "a", (F.col("eid") * 2 + 1 - F.col("side")).cast("long").alias("arc"), (F.col("r") % F.col("degree") + 1).alias("r"))
    out = arcs.select("tree_id", "a", "r", number.alias("next"))
    first = arcs.where(F.col("r") == 1).join(roots.withColumnRenamed("root", "a"), ["tree_id", "a"]).select(
        "tree_id", number.alias("next"), F.lit(True).alias("last"))
    linked = into.join(out, ["tree_id", "a", "r"]).join(broadcast_if_small(stored(first, "tours")), ["tree_id", "next"], "left")
    return linked.select("tree_id", "arc", F.when(F.col("last").isNull(), F.col("next")).alias("next"))


def steps_to_end(links: DataFrame, key: str = "arc") -> DataFrame:
    """(tree_id, ``key``, steps): list ranking by pointer jumping. A jump makes
    every pointer twice as long; two jumps a written round, so a list of n takes
    log4(n) rounds. What no end can be reached from is left out."""
    at = stored(links.select("tree_id", key, "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("steps")), "tour")
    longest = at.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def jump(df):
        on = df.select("tree_id", F.col(key).alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        return df.join(on, ["tree_id", "next"], "left").select(
            "tree_id", key, F.col("_next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
    reach = 1
    while reach < longest:
        at = stored(jump(jump(at)), "tour")
        reach *= 4
        if reach < longest and at.where(F.col("next").isNotNull()).isEmpty():
            break
    return at.where(F.col("next").isNull()).select("tree_id", key, "steps")


def orient(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(tree_id, vertex, parent, depth, eid, size)``; the root has parent -1,
    eid -1; ``size`` counts the subtree, the vertex itself included. Default
    root: vertex 0 of every tree. Vertices that the root doesn't reach have no row.

    Places on the Euler tour, found by list ranking, give all of it: of an
    edge's two arcs the first leads down, what lies between them is the subtree,
    and the depth is the running sum of steps down less steps up. The number of
    rounds is logarithmic in the size of a tree, whatever its depth."""
    if roots is None:
        roots = edges.select("tree_id").distinct().withColumn("root", F.lit(0))
    roots = stored(roots.select("tree_id", F.col("root").cast(edges.schema["u"].dataType).alias("root")), "roots")
    arcs = edges.select("tree_id", "eid", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0).alias("side")).unionByName(
        edges.select("tree_id", "eid", F.col("v").alias("a"), F.col("u").alias("b"), F.lit(1).alias("side")))
    arcs = stored(rank_in_groups(arcs, ["tree_id", "a"], ["eid", "side"], "r"), "arcs")
    ends = steps_to_end(successors(arcs, roots))
    number = (F.col("eid") * 2 + F.col("side")).cast("long").alias("arc")
    placed = arcs.select("tree_id", "eid", "a", "b", number).join(ends, ["tree_id", "arc"])
    # later arcs have fewer steps to the end
    edge = stored(placed.groupBy("tree_id", "eid").agg(
        F.max_by(F.struct("a", "b"), "steps").alias("down"), F.max("steps").alias("first"), F.min("steps").alias("last")), "edges")
    moves = edge.select("tree_id", "eid", (-F.col("first")).alias("at"), F.lit(1).cast("long").alias("step")).unionByName(
        edge.select("tree_id", "eid", (-F.col("last")).alias("at"), F.lit(-1).cast("long").alias("step")))
    level = prefix_in_groups(moves, ["tree_id"], ["at"], ["step"]).where(F.col("step") == 1).select(
        "tree_id", "eid", (F.col("step_before") + 1).cast("int").alias("depth"))
    below = edge.join(level, ["tree_id", "eid"]).select(
        "tree_id", F.col("down.b").alias("vertex"), F.col("down.a").alias("parent"), "depth", "eid",
        ((F.col("first") - F.col("last") + 1) / 2).cast("long").alias("size"))
    counts = edge.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    top = roots.join(counts, "tree_id", "left").select(
        "tree_id", F.col("root").alias("vertex"), F.lit(-1).cast(edges.schema["u"].dataType).alias("parent"), F.lit(0).alias("depth"),
        F.lit(-1).cast(edges.schema["eid"].dataType).alias("eid"), (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("size"))
    return top.unionByName(below)


def subtree_sizes(oriented: DataFrame) -> DataFrame:
    """``(tree_id, vertex, size)`` — size counts the vertex itself. Of a
    table without ``size`` the tours are made anew from the parents."""
    if "size" not in oriented.columns:
        o = stored(oriented, "oriented")
        edges = o.where("parent >= 0").select("tree_id", "eid", F.col("parent").alias("u"), F.col("vertex").alias("v"))
        oriented = orient(edges, o.where("parent < 0").select("tree_id", F.col("vertex").alias("root")))
    return oriented.select("tree_id", "vertex", "size")


def root_point(points: DataFrame) -> DataFrame:
    """``(tree_id, point_id)`` of the highest point (ties: smaller x, then id)."""
    key = F.struct(F.col("y"), -F.col("x"), -F.col("point_id"))
    return points.groupBy("tree_id").agg(F.max_by("point_id", key).alias("point_id"))


def centroids(points: DataFrame, group_cols) -> DataFrame:
    return points.groupBy(*group_cols).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"),
                                           F.count(F.lit(1)).alias("n"))


def polar_rank(points: DataFrame, pivots: DataFrame, group_cols, rank_col: str = "rank") -> DataFrame:
    """Rank each group's points by angle around the group's pivot ``(px, py)``
    relative to direction ``ref`` (pivots carry ``ref``), ties by point_id.
    Pivots are one row per group: a small written table is broadcast, so the
    points of a large group don't meet in one task."""
    g = list(group_cols)
    j = points.join(broadcast_if_small(stored(pivots, "pivots")), g).withColumn(
        "angle", rel_angle(polar_angle("px", "py", "x", "y"), F.col("ref")))
    return rank_in_groups(j, g, ["angle", "point_id"], rank_col)


def bin_starts(bins: DataFrame, group_cols, order_cols, cap_col: str = "cap", out: str = "lo") -> DataFrame:
    """``bins`` with the capacity of the earlier bins of the group in ``out``."""
    return prefix_in_groups(bins, group_cols, order_cols, [cap_col], suffix="__lo") \
        .withColumnRenamed(f"{cap_col}__lo", out)


def allocate(items: DataFrame, bins: DataFrame, group_cols, rank_col: str = "rank",
             bin_col: str = "bin", cap_col: str = "cap", lo_col: str = "lo") -> DataFrame:
    """Ranked items (1-based ``rank``) to bins that take consecutive ranks:
    item ``r`` goes to the bin with ``lo < r <= lo + cap``; items past the total
    capacity get no bin. A merge: bins stand in the order of the ranks where
    they begin, and every item takes the last bin before it, which is carried
    over the borders of partitions. No row per rank is made, and a huge bin or
    group is spread like any other rows."""
    g = list(group_cols)
    fields = [c for c in items.columns if c not in g]
    begin = bins.where(F.col(cap_col) > 0).select(
        *g, (F.col(lo_col) + 1).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(bin_col).alias("_bin"),
        (F.col(lo_col) + F.col(cap_col)).cast("long").alias("_last"),
        F.lit(None).cast(items.select(F.struct(*fields)).schema[0].dataType).alias("_item"))
    asks = items.select(*g, F.col(rank_col).cast("long").alias("_at"), F.lit(1).alias("_kind"),
                        F.lit(None).cast(bins.schema[bin_col].dataType).alias("_bin"), F.lit(None).cast("long").alias("_last"),
                        F.struct(*fields).alias("_item"))
    filled = forward_fill(begin.unionByName(asks), g, ["_at", "_kind"], ["_bin", "_last"])
    return filled.where((F.col("_kind") == 1) & (F.col("_at") <= F.col("_last"))).select(
        *[F.col(c) if c in g else F.col(f"_item.{c}").alias(c) for c in items.columns], F.col("_bin").alias(bin_col))


def _with_rel(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("rel", rel_angle(polar_angle("vx", "vy", x, y), F.col("pang")))


def embed(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Place every vertex on a distinct point: the root takes the highest point;
    each vertex takes the first point of its chunk, orders the rest by angle
    relative to the direction of its parent's point, hands consecutive runs
    (sized by subtree sizes, children in adjacency order) to its children,
    re-orders the children by the angle of their runs' centroids and hands
    the runs out again in that order. One tree level per iteration.
    Returns ``(tree_id, vertex, point_id)``."""
    ori = stored(orient(edges))
    kids_all = (ori.where(F.col("parent") >= 0)
                   .select("tree_id", F.col("parent").alias("vertex"), F.col("vertex").alias("child"), "eid", "size"))
    # where the run of a child starts in adjacency order, for all levels at once
    kids_all = stored(bin_starts(kids_all, ["tree_id", "vertex"], ["eid", "child"], "size"))
    depth = ori.agg(F.max("depth")).first()[0] or 0
    pts = points.select("tree_id", "point_id", "x", "y")
    rp = root_point(pts).withColumnRenamed("point_id", "_rp")
    roots = ori.where(F.col("depth") == 0).select("tree_id", "vertex")
    # a row per tree: broadcast while it is small, so that a tree's points don't meet in one task
    chunk = (pts.join(broadcast_if_small(stored(rp.join(roots, "tree_id"), "roots")), "tree_id")
                .select("tree_id", "vertex", "point_id",
                        F.when(F.col("point_id") == F.col("_rp"), 1).otherwise(2).cast("long").alias("crank")))
    parent_pts = None          # (tree_id, vertex, vx, vy) of the previous level
    assigned, level = [], 0
    while True:
        chunk = stored(chunk)
        own = chunk.where(F.col("crank") == 1).select("tree_id", "vertex", "point_id")
        assigned.append(own)
        vinfo = own.join(pts, ["tree_id", "point_id"]).select("tree_id", "vertex", F.col("x").alias("vx"),
                                                               F.col("y").alias("vy"))
        if parent_pts is None:
            vinfo = vinfo.withColumn("pang", F.lit(DOWN))
        else:
            par = ori.select("tree_id", "vertex", "parent")
            pp = parent_pts.select("tree_id", F.col("vertex").alias("parent"), F.col("vx").alias("ppx"),
                                   F.col("vy").alias("ppy"))
            vinfo = (vinfo.join(par, ["tree_id", "vertex"]).join(pp, ["tree_id", "parent"])
                          .withColumn("pang", polar_angle("vx", "vy", "ppx", "ppy"))
                          .select("tree_id", "vertex", "vx", "vy", "pang"))
        vinfo = stored(vinfo)
        rest = (chunk.where(F.col("crank") > 1).join(pts, ["tree_id", "point_id"]).join(vinfo, ["tree_id", "vertex"]))
        rest = _with_rel(rest, "x", "y")
        if level >= depth:
            break
        ranked = rank_in_groups(rest, ["tree_id", "vertex"], ["rel", "point_id"], "r")
        kids = kids_all.join(vinfo.select("tree_id", "vertex"), ["tree_id", "vertex"], "left_semi")
        # first pass: children in adjacency order
        first = allocate(ranked.select("tree_id", "vertex", "point_id", "x", "y", "r"), kids, ["tree_id", "vertex"],
                         rank_col="r", bin_col="child", cap_col="size")
        cen = centroids(first, ["tree_id", "vertex", "child"]).join(vinfo, ["tree_id", "vertex"])
        cen = _with_rel(cen, "cx", "cy").select("tree_id", "vertex", "child", F.col("rel").alias("cang"))
        # second pass: children by (centroid angle, child id, size)
        k2 = bin_starts(kids.drop("lo").join(cen, ["tree_id", "vertex", "child"]), ["tree_id", "vertex"],
                        ["cang", "child", "size"], "size")
        second = allocate(ranked.select("tree_id", "vertex", "point_id", "r"), k2, ["tree_id", "vertex"],
                          rank_col="r", bin_col="child", cap_col="size")
        nxt = (second.join(k2.select("tree_id", "vertex", "child", "lo"), ["tree_id", "vertex", "child"])
                     .select("tree_id", F.col("child").alias("vertex"), "point_id",
                             (F.col("r") - F.col("lo")).cast("long").alias("crank")))
        level += 1
        parent_pts = vinfo
        chunk = nxt
    return _union(assigned)


def segments(edges: DataFrame, assign: DataFrame, points: DataFrame) -> DataFrame:
    """Each edge with the coordinates of its endpoints' assigned points."""
    a = assign.join(points, ["tree_id", "point_id"]).select("tree_id", "vertex", "point_id", "x", "y")
    au = a.select("tree_id", F.col("vertex").alias("u"), F.col("point_id").alias("pu"), F.col("x").alias("x1"),
                  F.col("y").alias("y1"))
    av = a.select("tree_id", F.col("vertex").alias("v"), F.col("point_id").alias("pv"), F.col("x").alias("x2"),
                  F.col("y").alias("y2"))
    return edges.join(au, ["tree_id", "u"]).join(av, ["tree_id", "v"])


def is_permutation(assign: DataFrame, points: DataFrame) -> DataFrame:
    """Per tree: every vertex has exactly one point and no point is used twice."""
    a = assign.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_assigned"),
                                      F.countDistinct("point_id").alias("n_points_used"),
                                      F.countDistinct("vertex").alias("n_vertices"))
    p = points.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_points"))
    return a.join(p, "tree_id").withColumn(
        "ok", (F.col("n_assigned") == F.col("n_points")) & (F.col("n_points_used") == F.col("n_points"))
        & (F.col("n_vertices") == F.col("n_points")))
