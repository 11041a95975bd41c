"""Regression table from ``part``: W0 = (p_partkey % 1000) / 100, W1 = p_size / 10,
target y = p_retailprice / 100 + W1² (linear in W0, quadratic in W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def table(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_size", "p_retailprice")
    w1 = F.col("p_size") / 10.0
    return p.select("p_partkey", ((F.col("p_partkey") % 1000) / 100.0).alias("W0"), w1.alias("W1"),
                    (F.col("p_retailprice") / 100.0 + w1 * w1).alias("y"))


SQL = """(select p_partkey, (p_partkey % 1000) / 100.0 as W0, p_size / 10.0 as W1,
         p_retailprice / 100.0 + (p_size / 10.0) * (p_size / 10.0) as y from part)"""
