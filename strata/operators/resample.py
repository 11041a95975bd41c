"""Minority oversampling between nearest neighbours.

Every row of the smaller class is a seed, each as often as the others but for
the remainder, which falls to the first in the order of a hash of the key. A
synthetic row is a point on the segment from its seed to one of the seed's
``k`` nearest rows of the class (``knn``, exact); which one, and how far, follow
from a hash of seed, key and number, so the same whatever the partitions, and
the same in SQL (``draw``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import nearest
from .ranking import global_rank
from .util import stored


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5 of seed:part:...; SQL has the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def synthetic(minority: DataFrame, need: int, key: str, features: str = "x", k: int = 5, seed: int = 42) -> DataFrame:
    """(key, copy, neighbour, features): ``need`` points between rows of
    ``minority`` (unique keys, vectors of one length without nulls) and their
    neighbours. A minority of one row is repeated."""
    rows = stored(minority.select(F.col(key).cast("long").alias("key"), F.col(features).cast("array<double>").alias("x")), "minority")
    ranked = stored(global_rank(rows, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"))), "key"], "rank"), "seeds")
    n = ranked.count()
    if not n:
        return rows.select("key", F.lit(0).alias("copy"), F.lit(None).cast("long").alias("neighbour"), F.col("x").alias(features))
    each, more = divmod(need, n)
    copies = F.lit(each) + (F.col("rank") <= more).cast("int")
    drawn = ranked.where(copies > 0).select("key", "x", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    near = nearest(rows, k)
    degree = near.groupBy("key").agg(F.max("nth").alias("degree"))
    chosen = drawn.join(degree, "key", "left").withColumn(
        "nth", (F.floor(draw(seed + 1, F.col("key"), F.col("copy")) * F.col("degree")) + 1).cast("int"))
    pairs = chosen.join(near.select("key", "nth", "neighbour"), ["key", "nth"], "left")
    ends = pairs.join(rows.select(F.col("key").alias("neighbour"), F.col("x").alias("end")), "neighbour", "left")
    way = draw(seed + 2, F.col("key"), F.col("copy"))
    between = F.when(F.col("end").isNull(), F.col("x")).otherwise(F.zip_with("x", "end", lambda a, b: a + way * (b - a)))
    return ends.select("key", F.col("copy").cast("int").alias("copy"), "neighbour", between.alias(features))


def oversample(rows: DataFrame, key: str, label: str, features: str = "x", k: int = 5, seed: int = 42) -> DataFrame:
    """(label, features, synthetic): all rows, and synthetic ones that make the
    smaller class as large as the other."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    real = rows.select(label, features, F.lit(False).alias("synthetic"))
    if len(counts) < 2 or len(set(counts.values())) == 1:
        return real
    small = min(counts, key=counts.__getitem__)
    need = max(counts.values()) - counts[small]
    new = synthetic(rows.where(F.col(label) == small), need, key, features, k, seed)
    kind = rows.schema[label].dataType
    return real.unionByName(new.select(F.lit(small).cast(kind).alias(label), features, F.lit(True).alias("synthetic")))
