"""Route queries.

Grid: the ``nation`` table laid out 5 wide (r = key div 5, c = key mod 5),
cell type = the nation's region. Routes: every order, starting at its
customer's nation cell. Stops: every lineitem of the order in line order,
stop type = the region of the line's supplier. Cost = total Manhattan moves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routes as RT
from ..operators.ranking import rank_in_groups
from ..sources.grid import explode_stops, read_grid
from ..sources.tables import Tables
from .registry import query

GRID_W = 5


def grid_cells(t: Tables):
    n, r = t.nation, t.region
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.lit(0).alias("grid_id"), (F.col("n_nationkey") / GRID_W).cast("int").alias("r"),
                     (F.col("n_nationkey") % GRID_W).cast("int").alias("c"), F.col("r_name").alias("type")))


def route_starts(t: Tables):
    o, c = t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.col("o_orderkey").alias("route_id"), F.lit(0).alias("grid_id"),
                     (F.col("c_nationkey") / GRID_W).cast("int").alias("sr"),
                     (F.col("c_nationkey") % GRID_W).cast("int").alias("sc")))


def route_stops(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
           .join(r, n.n_regionkey == r.r_regionkey)
           .select(F.col("l_orderkey").alias("route_id"), "l_linenumber", "l_suppkey", F.col("r_name").alias("type")))
    # lines with equal (linenumber, suppkey) have equal types, so this order is total for the result
    return rank_in_groups(j, ["route_id"], ["l_linenumber", "l_suppkey"], "seq").select("route_id", "seq", "type")


ROUTES_SQL = """
with recursive
cells as (select n_nationkey // 5 as r, n_nationkey % 5 as c, r_name as type
          from nation join region on n_regionkey = r_regionkey),
routes as (select o_orderkey as route_id, c_nationkey // 5 as sr, c_nationkey % 5 as sc
           from orders join customer on o_custkey = c_custkey),
stops0 as (select l_orderkey as route_id, l_linenumber, l_suppkey, r_name as type
           from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey),
stops1 as (select route_id, row_number() over (partition by route_id order by l_linenumber, l_suppkey) as seq, type
           from stops0),
stops as (select route_id, row_number() over (partition by route_id order by seq) as seq, type
          from stops1 where type in (select type from cells)),
st(route_id, seq, r, c, cost) as (
  select route_id, 0, sr, sc, 0 from routes
  union all
  select st.route_id, st.seq + 1, x.r, x.c, min(st.cost + abs(st.r - x.r) + abs(st.c - x.c))
  from st join stops s on s.route_id = st.route_id and s.seq = st.seq + 1 join cells x on x.type = s.type
  group by st.route_id, st.seq + 1, x.r, x.c),
last as (select route_id, max(seq) as ms from st group by route_id)
select route_id, cast(min(cost) as bigint) as cost from st join last using (route_id) where seq = ms group by route_id
"""


@query("staged_route_cost", ROUTES_SQL)
def staged_route_cost(spark, sf):
    """G1 + J2 + P25 + A16: exact minimum travel for every order."""
    t = Tables(spark, sf)
    return RT.staged_route_cost(route_starts(t), route_stops(t), grid_cells(t))


@query("cells_by_type", """
select 0 as grid_id, r_name as type, count(*) as n_cells, cast(min(n_nationkey // 5) as integer) as min_r,
       cast(max(n_nationkey // 5) as integer) as max_r, cast(min(n_nationkey % 5) as integer) as min_c,
       cast(max(n_nationkey % 5) as integer) as max_c
from nation join region on n_regionkey = r_regionkey group by r_name
""")
def cells_by_type(spark, sf):
    """Cell index by type with counts."""
    return RT.cells_by_type(grid_cells(Tables(spark, sf)))


@query("nearest_cell", """
with routes as (select o_orderkey as route_id, c_nationkey // 5 as sr, c_nationkey % 5 as sc
                from orders join customer on o_custkey = c_custkey),
stops as (select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as seq,
                 r_name as type
          from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
          join region on n_regionkey = r_regionkey),
cells as (select n_nationkey // 5 as r, n_nationkey % 5 as c, r_name as type from nation join region on n_regionkey = r_regionkey),
j as (select route_id, seq, x.r, x.c, abs(sr - x.r) + abs(sc - x.c) as dist
      from routes join stops using (route_id) join cells x using (type))
select route_id, seq, cast(arg_min(r, (dist, r, c)) as integer) as to_r, cast(arg_min(c, (dist, r, c)) as integer) as to_c,
       cast(min(dist) as integer) as dist
from j group by route_id, seq
""")
def nearest_cell(spark, sf):
    """For every stop of every order, the cell of its type nearest to the start."""
    t = Tables(spark, sf)
    pts = route_stops(t).join(route_starts(t), "route_id").select(
        "route_id", "seq", "grid_id", F.col("sr").alias("r"), F.col("sc").alias("c"), "type")
    return RT.nearest_cell(pts, grid_cells(t)).select("route_id", "seq", "to_r", "to_c", "dist")


@query("valid_stops", """
with s as (select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as seq,
                  r_name as type
           from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey)
select route_id, row_number() over (partition by route_id order by seq) as seq, type from s where type <> 'EUROPE'
""")
def valid_stops(spark, sf):
    """P25 + J3: stops on a grid without the cells of one region, renumbered."""
    t = Tables(spark, sf)
    cells = grid_cells(t).where(F.col("type") != "EUROPE")
    return RT.valid_stops(route_stops(t), route_starts(t), cells).select("route_id", "seq", "type")


@query("text_grid_cells", """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as r
           from documents),
ch as (select r, unnest(string_split(line, '')) as type, generate_subscripts(string_split(line, ''), 1) - 1 as c from l)
select type, count(*) as n_cells, cast(max(r) as bigint) as max_r, cast(max(c) as bigint) as max_c,
       cast(sum(r) as bigint) as sum_r, cast(sum(c) as bigint) as sum_c
from ch where type <> '' group by type
""")
def text_grid_cells(spark, sf):
    """S5 + G3: every document read as a text grid (lines = rows, characters =
    cells); cells of every type with their places."""
    d = Tables(spark, sf).documents.select("doc_id", "text")
    lines = d.select(F.col("doc_id").alias("grid_id"),
                     F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return read_grid(lines).groupBy("type").agg(
        F.count(F.lit(1)).alias("n_cells"), F.max("r").cast("long").alias("max_r"), F.max("c").cast("long").alias("max_c"),
        F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query("stop_strings", """
with s as (select o_orderkey as route_id, o_orderpriority as stops from orders),
e as (select unnest(string_split(stops, '')) as type, generate_subscripts(string_split(stops, ''), 1) as seq from s)
select type, count(*) as n_stops, cast(sum(seq) as bigint) as sum_seq, cast(max(seq) as bigint) as max_seq
from e where type <> '' group by type
""")
def stop_strings(spark, sf):
    """Order-priority strings exploded into ordered stop characters."""
    o = Tables(spark, sf).orders.select(F.col("o_orderkey").alias("route_id"), F.col("o_orderpriority").alias("stops"))
    return explode_stops(o).groupBy("type").agg(F.count(F.lit(1)).alias("n_stops"), F.sum("seq").alias("sum_seq"),
                                                F.max("seq").cast("long").alias("max_seq"))
