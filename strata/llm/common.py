"""Helpers shared by the operators: table access, written intermediates, salted
ranks and span digests."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..operators.util import stored as written
from ..sources.tables import table

__all__ = ["table", "written", "process_cache", "arrow_column", "free_name", "refuse", "held_out",
           "salted_rank", "span_digests"]


def process_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker or until another operator
    asks for its own: what one leaves behind would else stay in memory through
    all later stages. Functions are shipped by value, so their module globals
    last for one task only."""
    cache = sys.__dict__.setdefault("_strata_llm_cache", {})
    if owner not in cache:
        cache.clear()
    return cache.setdefault(owner, {})


def arrow_column(fn, schema: str):
    """Turn ``fn(list of bytes or None) -> list of values`` into an Arrow UDF.
    Only the argument column travels to Python; the other columns of a row,
    whatever their names, stay in the JVM."""
    kind = to_arrow_type(_parse_datatype_string(schema))

    def run(col: pa.Array) -> pa.Array:
        return pa.array(fn(col.cast(pa.binary()).to_pylist()), type=kind)
    return arrow_udf(run, returnType=schema)


def refuse(df: DataFrame, *names: str) -> None:
    """An error if ``df`` has a column named like one that an operator adds: the
    rule of all operators for clashing names. Most let the caller choose another."""
    for name in names:
        if free_name(df, name) != name:
            raise ValueError(f"the table has a column {name} already; name another")


def free_name(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def salted_rank(df: DataFrame, key: str, order: list[str], salt: Column, out: str,
                buckets: int = 1024) -> DataFrame:
    """Gapless 0-based rank of each row among the rows of its ``key``.

    A key that holds a third of all rows is ranked in ``buckets`` parts: a
    window ranks each (key, bucket), and offsets are running sums over the
    bucket counts, of which there are at most ``buckets`` a key. ``buckets``
    bounds the offset table, not the rows. ``salt`` has to be a deterministic
    function of the row. Null keys form a key of their own.
    """
    b, c, o = free_name(df, "__bucket"), free_name(df, "__count"), free_name(df, "__before")
    k2, b2 = free_name(df, "__key2"), free_name(df, "__bucket2")
    dealt = df.withColumn(b, F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(F.col(key).alias(k2), F.col(b).alias(b2)).agg(F.count(F.lit(1)).alias(c))
    before = Window.partitionBy(k2).orderBy(b2).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(k2, b2, F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o))
    within = Window.partitionBy(key, b).orderBy(*order)
    return (dealt.withColumn(out, F.row_number().over(within).cast("long") - 1)
            .join(offsets, F.col(key).eqNullSafe(F.col(k2)) & (F.col(b) == F.col(b2)))
            .withColumn(out, F.col(out) + F.col(o)).drop(b, k2, b2, o))


def span_digests(spans: Column, base_kinds: tuple[str, ...]) -> dict[str, Column]:
    """Digest columns of an array of (kind, start, end, base) structs that is
    sorted by start, then kind: n_<kind> per base kind, base_sha256, spans."""
    def text(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda x: x["base"])
    out = {f"n_{k}": count(k) for k in base_kinds}
    out["base_sha256"] = F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256)
    out["spans"] = F.array_join(F.transform(spans, text), ",")
    return out
