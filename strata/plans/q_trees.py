"""Tree queries.

Trees: one per ``p_brand``; its parts numbered k = 0.. by ``p_partkey``;
vertex k's parent is (k − 1) div 2 (heap shape), edge order = k. Points:
part k is point k at (p_size, p_retailprice). Root = vertex 0.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import trees as TR
from ..operators.ranking import rank_in_groups
from ..operators.util import broadcast_if_small, stored
from ..sources.tables import Tables
from .registry import query, rounded


def tree_vertices(t: Tables):
    p = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    r = rank_in_groups(p, ["p_brand"], ["p_partkey"], "k1")
    return r.select(F.col("p_brand").alias("tree_id"), (F.col("k1") - 1).alias("k"),
                    F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def tree_edges(v):
    return v.where(F.col("k") >= 1).select("tree_id", F.col("k").alias("eid"),
                                           F.floor((F.col("k") - 1) / 2).cast("long").alias("u"),
                                           F.col("k").alias("v"))


def tree_points(v):
    return v.select("tree_id", F.col("k").alias("point_id"), "x", "y")


V_SQL = """v as (select p_brand as tree_id, row_number() over (partition by p_brand order by p_partkey) - 1 as k,
                  p_size::double as x, p_retailprice as y from part)"""
SIZES_SQL = """
anc(tree_id, k, a) as (select tree_id, k, k from v
                       union all select anc.tree_id, anc.k, (anc.a - 1) // 2 from anc where anc.a > 0),
sz as (select tree_id, a as vertex, count(*) as size from anc group by all)"""
ROOT_SQL = """rp as (select tree_id, arg_max(k, (y, -x, -k)) as rk, arg_max(x, (y, -x, -k)) as rx,
                     arg_max(y, (y, -x, -k)) as ry from v group by tree_id)"""
REL = "(case when ({a}) < 0 then ({a}) + 2 * pi() else ({a}) end)"


def rel_sql(a):
    inner = REL.format(a=a)
    return f"(case when {inner} >= 2 * pi() then {inner} - 2 * pi() else {inner} end)"


POLAR_SQL = f"""
pr as (select v.tree_id, v.k as point_id, v.x, v.y,
              {rel_sql('atan2(v.y - rp.ry, v.x - rp.rx) - (-pi() / 2)')} as angle
       from v join rp using (tree_id) where v.k <> rp.rk),
rk as (select *, row_number() over (partition by tree_id order by angle, point_id) as r from pr)"""
KIDS_SQL = """
kids as (select v.tree_id, k as child, k as eid, size from v join sz on sz.tree_id = v.tree_id and sz.vertex = v.k
         where k in (1, 2)),
lo1 as (select *, coalesce(sum(size) over (partition by tree_id order by eid rows between unbounded preceding and 1 preceding), 0) as lo
        from kids),
a1 as (select rk.*, lo1.child from rk join lo1 on rk.tree_id = lo1.tree_id and rk.r > lo1.lo and rk.r <= lo1.lo + lo1.size)"""


@query("root_point", f"""
with {V_SQL}, {ROOT_SQL}
select tree_id, rk as point_id from rp
""")
def root_point(spark, sf):
    """A15 + G6: the highest point of every tree (ties: smaller x, then id)."""
    return TR.root_point(tree_points(tree_vertices(Tables(spark, sf))))


@query("subtree_sizes", f"""
with recursive {V_SQL}, {SIZES_SQL}
select tree_id, vertex, size from sz
""")
def subtree_sizes(spark, sf):
    """Subtree size of every vertex of every tree."""
    v = stored(tree_vertices(Tables(spark, sf)), "vertices")
    return TR.subtree_sizes(TR.orient(tree_edges(v))).select("tree_id", "vertex", "size")


@query("polar_rank", f"""
with {V_SQL}, {ROOT_SQL}, {POLAR_SQL}
select tree_id, point_id, round(angle, 6) as angle, r as rank from rk
""")
def polar_rank(spark, sf):
    """W5 + G4 + O4: all points of a tree ordered by angle around its root point,
    relative to the downward direction."""
    v = stored(tree_vertices(Tables(spark, sf)), "vertices")
    pts = tree_points(v)
    rp = TR.root_point(pts).join(pts, ["tree_id", "point_id"]).select(
        "tree_id", F.col("point_id").alias("_rk"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.lit(TR.DOWN).alias("ref"))
    rest = pts.join(broadcast_if_small(stored(rp.select("tree_id", "_rk"), "roots")), "tree_id") \
        .where(F.col("point_id") != F.col("_rk")).drop("_rk")
    r = TR.polar_rank(rest, rp.drop("_rk"), ["tree_id"])
    return rounded(r.select("tree_id", "point_id", "angle", "rank"))


def _root_level(spark, sf):
    v = stored(tree_vertices(Tables(spark, sf)), "vertices")
    pts, edges = tree_points(v), tree_edges(v)
    sizes = TR.subtree_sizes(TR.orient(edges))
    rp = TR.root_point(pts).join(pts, ["tree_id", "point_id"]).select(
        "tree_id", F.col("point_id").alias("_rk"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.lit(TR.DOWN).alias("ref"))
    rp = stored(rp, "roots")
    rest = pts.join(broadcast_if_small(rp.select("tree_id", "_rk")), "tree_id").where(F.col("point_id") != F.col("_rk"))
    # read by both passes
    ranked = stored(TR.polar_rank(rest.drop("_rk"), rp.drop("_rk"), ["tree_id"], "r"), "ranked")
    kids = (edges.where(F.col("u") == 0).select("tree_id", F.col("v").alias("vertex"), "eid")
                 .join(sizes, ["tree_id", "vertex"])
                 .select("tree_id", F.col("vertex").alias("child"), "eid", "size"))
    return ranked, stored(TR.bin_starts(kids, ["tree_id"], ["eid", "child"], "size"), "kids"), rp


@query("quota_allocate", f"""
with recursive {V_SQL}, {SIZES_SQL}, {ROOT_SQL}, {POLAR_SQL}, {KIDS_SQL}
select tree_id, point_id, child from a1
""")
def quota_allocate(spark, sf):
    """J6 + W6: the root's points, ranked by angle, handed to its children in
    adjacency order in runs of their subtree sizes."""
    ranked, kids, _ = _root_level(spark, sf)
    a = TR.allocate(ranked.select("tree_id", "point_id", "r"), kids, ["tree_id"], rank_col="r",
                    bin_col="child", cap_col="size")
    return a.select("tree_id", "point_id", "child")


CENT_SQL = f"""
cen as (select tree_id, child, avg(x) as cx, avg(y) as cy, count(*) as n from a1 group by all),
ca as (select cen.*, {rel_sql('atan2(cy - rp.ry, cx - rp.rx) - (-pi() / 2)')} as cang from cen join rp using (tree_id))"""


@query("centroids", f"""
with recursive {V_SQL}, {SIZES_SQL}, {ROOT_SQL}, {POLAR_SQL}, {KIDS_SQL}, {CENT_SQL}
select tree_id, child, round(cx, 6) as cx, round(cy, 6) as cy, n, round(cang, 6) as cang from ca
""")
def centroids(spark, sf):
    """Centroids of the first-pass runs and their angles around the root point."""
    ranked, kids, rp = _root_level(spark, sf)
    a = TR.allocate(ranked.select("tree_id", "point_id", "x", "y", "r"), kids, ["tree_id"], rank_col="r",
                    bin_col="child", cap_col="size")
    c = TR.centroids(a, ["tree_id", "child"]).join(rp, "tree_id")
    from ..functions.columns import polar_angle, rel_angle
    c = c.withColumn("cang", rel_angle(polar_angle("px", "py", "cx", "cy"), F.col("ref")))
    return rounded(c.select("tree_id", "child", "cx", "cy", "n", "cang"))


@query("child_partition", f"""
with recursive {V_SQL}, {SIZES_SQL}, {ROOT_SQL}, {POLAR_SQL}, {KIDS_SQL}, {CENT_SQL},
k2 as (select kids.*, ca.cang from kids join ca using (tree_id, child)),
lo2 as (select *, coalesce(sum(size) over (partition by tree_id order by cang, child, size
               rows between unbounded preceding and 1 preceding), 0) as lo from k2)
select rk.tree_id, rk.point_id, lo2.child, cast(rk.r - lo2.lo as bigint) as crank
from rk join lo2 on rk.tree_id = lo2.tree_id and rk.r > lo2.lo and rk.r <= lo2.lo + lo2.size
""")
def child_partition(spark, sf):
    """Second pass — children re-ordered by the angle of their first-pass
    centroids, runs re-dealt in that order (the chunk each child recurses on)."""
    ranked, kids, rp = _root_level(spark, sf)
    a = TR.allocate(ranked.select("tree_id", "point_id", "x", "y", "r"), kids, ["tree_id"], rank_col="r",
                    bin_col="child", cap_col="size")
    from ..functions.columns import polar_angle, rel_angle
    c = TR.centroids(a, ["tree_id", "child"]).join(rp, "tree_id").withColumn(
        "cang", rel_angle(polar_angle("px", "py", "cx", "cy"), F.col("ref")))
    k2 = stored(TR.bin_starts(kids.drop("lo").join(c.select("tree_id", "child", "cang"), ["tree_id", "child"]),
                              ["tree_id"], ["cang", "child", "size"], "size"), "kids")
    b = TR.allocate(ranked.select("tree_id", "point_id", "r"), k2, ["tree_id"], rank_col="r",
                    bin_col="child", cap_col="size")
    return (b.join(k2.select("tree_id", "child", "lo"), ["tree_id", "child"])
             .select("tree_id", "point_id", "child", (F.col("r") - F.col("lo")).cast("long").alias("crank")))


PANG = "case when px is null then -pi() / 2 else atan2(py - vy, px - vx) end"
EMBED_SQL = f"""
kl as (select v.tree_id, (v.k - 1) // 2 as vertex, v.k as child, sz.size,
              coalesce(sum(sz.size) over (partition by v.tree_id, (v.k - 1) // 2 order by v.k
                       rows between unbounded preceding and 1 preceding), 0) as lo
       from v join sz on sz.tree_id = v.tree_id and sz.vertex = v.k where v.k >= 1),
st(level, tree_id, vertex, point_id, x, y, crank, px, py) as (
  select 0, v.tree_id, cast(0 as bigint), v.k, v.x, v.y, cast(case when v.k = rp.rk then 1 else 2 end as bigint), null::double, null::double
  from v join rp using (tree_id)
  union all
  select level + 1, tree_id, kids[r], point_id, x, y, cast(r - los[r] as bigint), vx, vy
  from (select *, list(child) over (partition by tree_id, vertex order by cang, child, r
                                    rows between unbounded preceding and unbounded following) as kids,
               list(lo2) over (partition by tree_id, vertex order by cang, child, r
                               rows between unbounded preceding and unbounded following) as los
        from (select *, rank() over (partition by tree_id, vertex order by cang, child) - 1 as lo2
              from (select *, {rel_sql(f'atan2(cy - vy, cx - vx) - ({PANG})')} as cang
                    from (select c.*, kl.child, avg(x) over (partition by c.tree_id, c.vertex, kl.child) as cx,
                                 avg(y) over (partition by c.tree_id, c.vertex, kl.child) as cy
                          from (select *, row_number() over (partition by tree_id, vertex order by rel, point_id) as r
                                from (select *, {rel_sql(f'atan2(y - vy, x - vx) - ({PANG})')} as rel
                                      from (select *, max(case when crank = 1 then x end) over (partition by tree_id, vertex) as vx,
                                                   max(case when crank = 1 then y end) over (partition by tree_id, vertex) as vy
                                            from st) a where crank > 1) b) c
                          join kl on kl.tree_id = c.tree_id and kl.vertex = c.vertex and c.r > kl.lo and c.r <= kl.lo + kl.size) d) e) f) g),
emb as (select tree_id, vertex, point_id, x, y from st where crank = 1)"""


@query("tree_embedding", f"""
with recursive {V_SQL}, {SIZES_SQL}, {ROOT_SQL}, {EMBED_SQL}
select tree_id, vertex, point_id from emb
""")
def tree_embedding(spark, sf):
    """The whole embedding (every vertex of every brand tree gets a point),
    one level per iteration."""
    v = stored(tree_vertices(Tables(spark, sf)), "vertices")
    return TR.embed(tree_edges(v), tree_points(v))


@query("segments", f"""
with recursive {V_SQL}, {SIZES_SQL}, {ROOT_SQL}, {EMBED_SQL}
select a.tree_id, a.vertex as u, b.vertex as v, a.x as x1, a.y as y1, b.x as x2, b.y as y2, true as ok
from emb b join emb a on a.tree_id = b.tree_id and a.vertex = (b.vertex - 1) // 2 where b.vertex >= 1
""")
def segments(spark, sf):
    """G7 + J5: embedded edges as segments, plus the permutation check per tree."""
    v = stored(tree_vertices(Tables(spark, sf)), "vertices")
    pts, edges = tree_points(v), tree_edges(v)
    a = TR.embed(edges, pts)
    seg = TR.segments(edges, a, pts)
    ok = TR.is_permutation(a, pts).select("tree_id", "ok")
    return seg.join(ok, "tree_id").select("tree_id", "u", "v", "x1", "y1", "x2", "y2", "ok")
