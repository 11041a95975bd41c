"""File sources and sinks: header CSV with an explicit schema (S1), the
single-column prediction CSV (S3), JSON records with rounded columns (S4),
and a stable row key (S8).

Sinks write Spark's distributed part-file layout (one folder); nothing is
funnelled through the driver or a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
               sep: str = ",") -> DataFrame:
    """CSV with a declared schema (no inference); empty fields are NULL."""
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("mode", "FAILFAST").csv(path))


def split_xy(df: DataFrame, target: str):
    """(features, target) projections of one table."""
    return df.drop(target), df.select(target)


def write_predictions(df: DataFrame, path: str, key: str, col: str = "target",
                      keep_key: bool = True, mode: str = "overwrite") -> None:
    """S3: prediction table as header CSV. Rows carry their key (Spark has no
    positional order); ``sortWithinPartitions`` keeps each part file ordered
    without a global sort into one task."""
    cols = [key, col] if keep_key else [col]
    (df.select(*cols).repartitionByRange(key).sortWithinPartitions(key)
       .write.mode(mode).option("header", True).csv(path))


def write_json_records(df: DataFrame, path: str, round_cols=(), digits: int = 3,
                       mode: str = "overwrite") -> None:
    """JSON-lines records, ``round_cols`` rounded half-even to ``digits``."""
    out = df.select(*[F.bround(F.col(c), digits).alias(c) if c in round_cols else F.col(c)
                      for c in df.columns])
    out.write.mode(mode).json(path)


def read_json_records(spark: SparkSession, path: str, schema: StructType | str,
                      multiline: bool = False) -> DataFrame:
    """Read JSON lines (or one JSON array per file with ``multiline``)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


#: Rows that a single JSON array may have: it is one record of one file.
ARRAY_ROWS = 100_000


def write_json_array(df: DataFrame, path: str, round_cols=(), digits: int = 3, mode: str = "overwrite") -> None:
    """One JSON array of objects in one file, for results that a program
    reads whole. Larger tables are refused; write them as JSON lines."""
    if df.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        raise ValueError(f"a JSON array holds at most {ARRAY_ROWS} rows; use write_json_records")
    row = F.struct(*[F.bround(F.col(c), digits).alias(c) if c in round_cols else F.col(c) for c in df.columns])
    text = df.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))
    text.coalesce(1).write.mode(mode).text(path)


def with_row_key(df: DataFrame, cols=None, out: str = "row_key") -> DataFrame:
    """A deterministic key from the row's content: md5 of the columns, each
    with its length before it and null as a mark of its own, so that different
    rows never spell the same text. Equal rows get equal keys — never a
    ``monotonically_increasing_id``, which changes with partitioning."""
    cols = list(cols or df.columns)
    texts = [F.col(c).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return df.withColumn(out, F.md5(F.concat(*parts)))
