"""Score a stream with plans fitted in batch: readStream → fitted projections
→ writeStream. No state, no watermark: each micro-batch is independent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType | str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(stream: DataFrame, transforms) -> DataFrame:
    """Apply fitted, stateless transforms (callables ``DataFrame -> DataFrame``)."""
    out = stream
    for t in transforms:
        out = t(out)
    return out

