"""Exact ranks, running sums and fills over a total order, at any group size.

A window without a partition, or over one huge group, moves its rows into one
task. Here the rows are range-partitioned by (group, order) and written once;
each row keeps its partition and its place in it. Everything else follows from
that table: places within a partition are local, and one number per partition
(its row count, or its sum) is all that crosses partitions. Every branch of a
plan reads the same written table, so a lost executor or a retried task can't
move a bound. A hot group simply fills several partitions.

Nulls order first and form a group of their own, as in SQL windows. The order
columns should be unique within a group; ties get ranks in some fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import broadcast_if_small, stored

_PART, _PLACE = "_rk_part", "_rk_place"
_LOCAL = (1 << 33) - 1  # the low bits of monotonically_increasing_id count within a partition


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ordered(df: DataFrame, order_cols) -> DataFrame:
    """``df`` written in ``order_cols`` order, with partition and place (from 0)."""
    keys = _cols(order_cols)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    got = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .withColumn(_PLACE, F.monotonically_increasing_id())
    return stored(got, "ordered").select(
        *df.columns, F.shiftright(_PLACE, 33).alias(_PART), F.col(_PLACE).bitwiseAND(F.lit(_LOCAL)).alias(_PLACE))


def _running(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """(partition, <name>...): the totals of all earlier partitions; a row per
    partition, which is as many as there are shuffle partitions."""
    rows = sorted(df.groupBy(_PART).agg(*[c.alias(n) for n, c in totals.items()]).collect(), key=lambda r: r[_PART])
    kinds = df.groupBy(_PART).agg(*[c.alias(n) for n, c in totals.items()]).schema
    out, before = [], {n: None for n in totals}
    for r in rows:
        out.append((r[_PART], *(before[n] or 0 for n in totals)))
        for n in totals:
            before[n] = (before[n] or 0) + (r[n] or 0)
    kind = ", ".join(f"{n} {kinds[n].dataType.simpleString()}" for n in totals)
    cast = [(p, *(type_of(kinds[n].dataType.typeName(), v) for n, v in zip(totals, vs))) for p, *vs in out]
    return F.broadcast(df.sparkSession.createDataFrame(cast, f"{_PART} long, {kind}"))


def type_of(name: str, v):
    return float(v) if name in ("double", "float") else v


def _by_group(df: DataFrame, starts: DataFrame, group_cols) -> DataFrame:
    """Join of one row per group onto all rows, null keys included. Few groups
    are broadcast, so that the rows of a hot one stay where they are; beyond that
    adaptive execution splits them."""
    starts = broadcast_if_small(stored(starts, "starts"))
    on = None
    for c in group_cols:
        same = F.col(c).eqNullSafe(F.col(f"_st_{c}"))
        on = same if on is None else on & same
    return df.join(starts, on).drop(*[f"_st_{c}" for c in group_cols])


def global_rank(df: DataFrame, order_cols, rank_col: str = "rank") -> DataFrame:
    """1-based ``row_number() over (order by order_cols)``."""
    rows = ordered(df, order_cols)
    before = _running(rows, {"_rk_before": F.count(F.lit(1))})
    return rows.join(before, _PART).withColumn(rank_col, F.col("_rk_before") + F.col(_PLACE) + 1) \
        .select(*df.columns, rank_col)


def rank_in_groups(df: DataFrame, group_cols, order_cols, rank_col: str = "rank") -> DataFrame:
    """``row_number() over (partition by group_cols order by order_cols)``."""
    g = list(group_cols)
    if not g:
        return global_rank(df, order_cols, rank_col)
    rows = ordered(df, g + list(order_cols))
    before = _running(rows, {"_rk_before": F.count(F.lit(1))})
    ranked = rows.join(before, _PART).withColumn("_rk_all", F.col("_rk_before") + F.col(_PLACE))
    starts = ranked.groupBy(*[F.col(c).alias(f"_st_{c}") for c in g]).agg(F.min("_rk_all").alias("_rk_first"))
    return _by_group(ranked, starts, g).withColumn(rank_col, F.col("_rk_all") - F.col("_rk_first") + 1) \
        .select(*df.columns, rank_col)


def prefix_in_groups(df: DataFrame, group_cols, order_cols, value_cols, suffix: str = "_before",
                     rank_col: str | None = None) -> DataFrame:
    """For each row the sums of ``value_cols`` over the rows before it in its
    group, as ``<value><suffix>`` (nulls count as 0), and optionally its rank."""
    g = list(group_cols)
    ones = {"_rk_one": F.lit(1).cast("long")} if rank_col else {}
    rows = ordered(df, g + list(order_cols)).withColumns(ones)
    names = {v: f"{v}{suffix}" for v in value_cols} | ({"_rk_one": rank_col} if rank_col else {})
    local = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    before = _running(rows, {f"_pb_{i}": F.sum(v) for i, v in enumerate(names)})
    sums = rows.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_pl_{i}") for i, v in enumerate(names)]) \
        .join(before, _PART)
    sums = sums.withColumns({f"_ps_{i}": F.col(f"_pb_{i}") + F.col(f"_pl_{i}") for i in range(len(names))})
    if g:
        at = F.struct(_PART, _PLACE)
        starts = sums.groupBy(*[F.col(c).alias(f"_st_{c}") for c in g]).agg(
            *[F.min_by(f"_ps_{i}", at).alias(f"_pf_{i}") for i in range(len(names))])
        sums = _by_group(sums, starts, g)
    else:
        sums = sums.withColumns({f"_pf_{i}": F.lit(0) for i in range(len(names))})
    out = [(F.col(f"_ps_{i}") - F.col(f"_pf_{i}") + (1 if n == rank_col else 0)).alias(n)
           for i, n in enumerate(names.values())]
    return sums.select(*df.columns, *out)


def forward_fill(df: DataFrame, group_cols, order_cols, value_cols) -> DataFrame:
    """Replace nulls of ``value_cols`` by the last values before them in the
    group. A row's value columns are all null or all set (one marker)."""
    g, vs = list(group_cols), list(value_cols)
    rows = ordered(df, g + list(order_cols)).withColumn("_ff_mark", F.when(F.col(vs[0]).isNotNull(), F.struct(*vs)))
    local = Window.partitionBy(_PART, *g).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ff", F.last("_ff_mark", ignorenulls=True).over(local))
    # the last marker of a group in each partition it reaches, carried on to the partitions after
    ends = rows.groupBy(_PART, *g).agg(F.max_by("_ff_mark", F.when(F.col("_ff_mark").isNotNull(), F.col(_PLACE))).alias("_ff_end"))
    after = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy(_PART) \
        .rowsBetween(Window.unboundedPreceding, -1)  # at most a row per partition
    carry = ends.select(F.col(_PART).alias("_ff_part"), *[F.col(c).alias(f"_st_{c}") for c in g],
                        F.last("_ff_end", ignorenulls=True).over(after).alias("_ff_carry"))
    on = F.col(_PART) == F.col("_ff_part")
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"_st_{c}"))
    filled = rows.join(carry, on, "left").withColumn("_ff", F.coalesce("_ff", "_ff_carry"))
    return filled.select(*[c for c in df.columns if c not in vs], *[F.col(f"_ff.{v}").alias(v) for v in vs])
