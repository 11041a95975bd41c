"""Small plan helpers: written intermediates and broadcasts of a checked size."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Bytes that a side may have to be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning, and tells
    the optimizer the size. ``session.clear_scratch`` deletes such tables."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for paths in _records():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCAL = threading.local()


def _records() -> list[list[str]]:
    """The lists that ``recording`` fills in this thread, innermost last."""
    if not hasattr(_LOCAL, "records"):
        _LOCAL.records = []
    return _LOCAL.records


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the tables that are ``stored`` in the block, by this thread."""
    paths: list[str] = []
    _records().append(paths)
    try:
        yield paths
    finally:
        _records().pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A broadcast hint for a written or source table whose size, as the
    optimizer knows it, is at most ``BROADCAST_BYTES``. Runs no job; beyond
    the limit the join is left to adaptive execution."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
