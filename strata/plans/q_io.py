"""Source/sink queries (S1–S4, S8, P1, P17, O2): write to the shared
checkpoint folder, read back with a declared schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files as FS
from ..sources.tables import Tables
from .registry import query

ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"


@query("write_read_csv", """
select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders
""")
def write_read_csv(spark, sf):
    """S1 + S3 + P1: orders projected, written as header CSV, read back with a schema."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "orders_csv")
    o.write.mode("overwrite").option("header", True).csv(path)
    return FS.read_table(spark, path, ORDERS_SCHEMA)


@query("write_read_json", """
select p_partkey, p_size, round_even(p_retailprice / 7.0, 3) as price_per_7 from part
""")
def write_read_json(spark, sf):
    """S4 + P17: JSON records with a value rounded half-even to 3 places, read back."""
    p = Tables(spark, sf).part.select("p_partkey", "p_size", (F.col("p_retailprice") / 7.0).alias("price_per_7"))
    path = scratch_path(spark, "part_json")
    FS.write_json_records(p, path, round_cols=["price_per_7"], digits=3)
    return FS.read_json_records(spark, path, "p_partkey long, p_size int, price_per_7 double")


@query("prediction_csv", """
select o_orderkey, cast(o_totalprice > 250000 as integer) as target from orders
""")
def prediction_csv(spark, sf):
    """S3 + P23: a keyed class column (threshold rule) through the prediction sink."""
    o = Tables(spark, sf).orders.select("o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("target"))
    path = scratch_path(spark, "pred_csv")
    FS.write_predictions(o, path, "o_orderkey", "target")
    return FS.read_table(spark, path, "o_orderkey long, target int")


ROW_KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("row_key", f"""
select md5(concat_ws('', {', '.join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ROW_KEY_COLS)})) as row_key,
       count(*) as n
from lineitem group by 1
""")
def row_key(spark, sf):
    """Content keys for lineitem (its (orderkey, linenumber) is not unique);
    rows per key shows the exact duplicates."""
    li = Tables(spark, sf).lineitem.select(*ROW_KEY_COLS)
    return FS.with_row_key(li).groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))


@query("json_array", """
select n_nationkey, n_name, round_even(n_nationkey / 7.0, 3) as share from nation
""")
def json_array(spark, sf):
    """A small result as one JSON array of objects, read back."""
    n = Tables(spark, sf).nation.select("n_nationkey", "n_name", (F.col("n_nationkey") / 7.0).alias("share"))
    path = scratch_path(spark, "nation_json")
    FS.write_json_array(n, path, round_cols=["share"], digits=3)
    return FS.read_json_records(spark, path, "n_nationkey int, n_name string, share double", multiline=True)


@query("head_orders", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10
""")
def head_orders(spark, sf):
    """O2 + O1: top-10 orders by price (an ordered head: TakeOrderedAndProject)."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
