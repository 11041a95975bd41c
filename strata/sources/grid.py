"""Text-grid and stop-string scans (S5, S6) and 1-based → 0-based tree input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_grid(lines: DataFrame, grid_col: str = "grid_id", row_col: str = "r",
              line_col: str = "line") -> DataFrame:
    """``(grid_id, r, line)`` → one row per character ``(grid_id, r, c, type)``."""
    return lines.select(grid_col, row_col,
                        F.posexplode(F.split(F.col(line_col), "")).alias("c", "type")) \
                .where(F.col("type") != "")


def explode_stops(df: DataFrame, route_col: str = "route_id", stops_col: str = "stops") -> DataFrame:
    """A stop string → ordered stops ``(route_id, seq, type)``, seq 1-based."""
    return (df.select(route_col, F.posexplode(F.split(F.col(stops_col), "")).alias("pos", "type"))
              .where(F.col("type") != "")
              .select(route_col, (F.col("pos") + 1).alias("seq"), "type"))


def to_zero_based(df: DataFrame, cols) -> DataFrame:
    return df.select(*[(F.col(c) - 1).alias(c) if c in cols else F.col(c) for c in df.columns])
