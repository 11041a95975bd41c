"""Minimum-cost-flow resharding.

Rows lie in old shards and are to lie in ``shards`` new ones of near-equal
bytes. Old shards are cut into blocks (a size band and a hash bucket), whose
sums the driver gets: at most old shards * 256 bands * ``buckets`` rows. A
minimum-cost flow from the old sizes to the new capacities, at a cost of 0 for
bytes that stay in the shard of their number and of 1 a byte for the others,
says how many bytes go from where to where. Each old shard then deals out its
blocks, those of the largest rows first, to whichever shard still needs most; a
block that is too large for that is split by the running sum of its rows'
sizes. Splits fall on the smallest rows, so a new shard misses its capacity by
less than a few of them.

Slots are gapless ranks in the shard, made in parts (``salted_rank``).

Cases: a null text has size 1 and the checksum of no bytes. Null old-shard keys
are a shard's like any other value. Repeated rows are rows of their own. An
empty table gives an empty result. A column named like an output is refused;
other columns stay.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.util import broadcast_if_small
from ..session import scratch_path
from .common import free_name, refuse, salted_rank, written


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each supplier to each consumer at least total cost.
    Successive shortest paths; the capacities must hold the supply."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # shortest path in the residual graph from any supplier with units left (Bellman-Ford with a queue)
        dist = {("s", i): 0 for i in range(n) if left[i]}
        back: dict = {}
        queue = deque(dist)
        while queue:
            side, i = at = queue.popleft()
            steps = [(("t", j), cost[i][j]) for j in range(m)] if side == "s" else \
                [(("s", k), -cost[k][i]) for k in range(n) if flow[k][i]]
            for to, c in steps:
                if dist[at] + c < dist.get(to, 1 << 62):
                    dist[to] = dist[at] + c
                    back[to] = at
                    if to not in queue:
                        queue.append(to)
        ends = [j for j in range(m) if room[j] and ("t", j) in dist]
        if not ends:
            raise ValueError("the capacities are smaller than the supply")
        j = min(ends, key=lambda j: (dist["t", j], j))
        path = [("t", j)]
        while path[-1] in back:
            path.append(back[path[-1]])
        start = path[-1][1]
        amount = min(left[start], room[j])
        for to, at in zip(path, path[1:]):
            if to[0] == "s":  # a step back from consumer at[1] to supplier to[1]
                amount = min(amount, flow[to[1]][at[1]])
        for to, at in zip(path, path[1:]):
            if to[0] == "t":
                flow[at[1]][to[1]] += amount
            else:
                flow[to[1]][at[1]] -= amount
        left[start] -= amount
        room[j] -= amount
    return flow


def reshard(rows: DataFrame, shards: int, old: str = "old_shard", size: str = "size",
            order: tuple[str, ...] = ("doc_id",), buckets: int = 128, shard: str = "shard",
            slot: str = "slot") -> DataFrame:
    """``rows`` with the new ``shard`` and the ``slot`` in it. ``old`` is an int
    from 0 (few values: shards, not keys); ``order`` fixes ties."""
    refuse(rows, shard, slot)
    names = {k: free_name(rows, f"__{k}") for k in ("old", "band", "bucket", "middle", "at")}
    given, old, band, bucket, before = old, names["old"], names["band"], names["bucket"], names["middle"]
    # four bands to a doubling, so sizes in a block differ by a fifth at most
    cut = written(rows.withColumn(old, F.coalesce(F.col(given), F.lit(-1)).cast("int"))
                  .withColumn(band, F.floor(4 * F.log2(F.col(size))).cast("int"))
                  .withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), "reshard")
    blocks = cut.groupBy(old, band, bucket).agg(F.sum(size).alias("bytes")).collect()
    by_old: dict[int, list] = {}
    for r in sorted(blocks, key=lambda r: (r[old], -r[band], r[bucket])):
        by_old.setdefault(r[old], []).append(r)
    total = sum(r["bytes"] for r in blocks)
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    olds = sorted(by_old)
    flow = min_cost_flow([sum(r["bytes"] for r in by_old[i]) for i in olds], capacity,
                         [[int(i != j) for j in range(shards)] for i in olds])
    parts = []
    for i, out in zip(olds, flow):
        parts += transfers([(r[band], r[bucket], r["bytes"]) for r in by_old[i]], out, i)
    keys = [f"{c}2" for c in (old, band, bucket)]
    lo, hi = f"{names['at']}_lo", f"{names['at']}_hi"
    plan = written(small_table(rows.sparkSession, parts, [*((k, "int") for k in keys), (lo, "long"), (hi, "long"), (shard, "int")]), "plan")
    within = Window.partitionBy(old, band, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row goes where its middle byte falls
    middle = F.coalesce(F.sum(size).over(within), F.lit(0)) + F.floor(F.col(size) / 2)
    on = (F.col(before) >= F.col(lo)) & (F.col(before) < F.col(hi))
    for c, k in zip((old, band, bucket), keys):
        on = (F.col(c) == F.col(k)) & on
    placed = cut.withColumn(before, middle).join(broadcast_if_small(plan), on).select(*rows.columns, shard)
    return salted_rank(written(placed, "resharded"), shard, list(order), F.xxhash64(*order), slot) \
        .select(*rows.columns, shard, slot)


def transfers(blocks: list[tuple[int, int, int]], need: list[int], old: int) -> list[tuple]:
    """(old, band, bucket, from byte, to byte, new shard) for the blocks of an
    old shard, largest rows first: each goes whole to the shard that still
    needs most, and is split where it is larger than that, so that splits fall
    on the smallest rows."""
    left, out = list(need), []
    for band, bucket, size in blocks:
        at = 0
        while at < size:
            j = max(range(len(left)), key=lambda j: (left[j], j == old, -j))
            take = min(size - at, left[j])
            out.append((old, band, bucket, at, at + take, j))
            left[j] -= take
            at += take
    return out


def small_table(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A table of a few plan-sized rows from the driver."""
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in schema))


def text_sizes(docs: DataFrame, text: Column, size: str = "size", checksum: str = "text_crc32") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 1) and ``checksum``."""
    refuse(docs, size, checksum)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.withColumn(size, F.octet_length(raw).cast("long") + 1).withColumn(checksum, F.crc32(raw))


def rewrite(rows: DataFrame, old: str, shard: str, source: str, target: str) -> list[int]:
    """Write the shards whose rows changed as ``target``/<shard>=n folders and
    return their numbers: a shard that lost or got no row keeps its files.
    ``rows`` has the old and new shard of every row with all its columns;
    ``source`` holds the old files and must not be ``target``."""
    if source == target:
        raise ValueError("files that are read can't be overwritten")
    moved = rows.where(F.col(old) != F.col(shard))
    touched = moved.select(F.explode(F.array(F.col(old), F.col(shard))).alias("n")).distinct()
    numbers = sorted(r["n"] for r in touched.collect())  # shards, not rows
    rows.where(F.col(shard).isin(numbers)).drop(old).write.partitionBy(shard).mode("overwrite") \
        .option("compression", "zstd").parquet(target)
    return numbers


def move(rows: DataFrame, shards: int, old: str = "old_shard", size: str = "size", order: tuple[str, ...] = ("doc_id",),
         shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with all their columns but ``old``, read from the files of the new
    shards, with ``shard`` and ``slot``. Places are found on the columns that
    ``reshard`` needs; the whole rows meet them in one join and are written."""
    refuse(rows, shard, slot)
    spark, row = rows.sparkSession, free_name(rows, "__row")
    # numbered as written: later reads see the same numbers
    path, target = scratch_path(spark, "old_shards"), scratch_path(spark, "new_shards")
    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    source = spark.read.schema(numbered.schema).parquet(path)
    slim = source.select(*dict.fromkeys([row, old, size, *order]))
    placed = written(reshard(slim, shards, old, size, order, shard=shard, slot=slot).select(row, shard, slot), "placed")
    # a merge join at every size: the list of places grows with the rows, so it is never broadcast
    whole = source.join(placed.hint("merge"), row).drop(row)
    numbers = rewrite(whole, old, shard, path, target)
    names = [*(c for c in rows.columns if c != old), shard, slot]
    new = spark.read.schema(whole.drop(old).schema).parquet(target).select(*names)
    if set(range(shards)) <= set(numbers):
        return new
    return new.unionByName(whole.where(~F.col(shard).isin(numbers)).select(*names))  # these shards keep their files
