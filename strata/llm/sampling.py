"""Bounded labelled samples, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int],
                    calibration: int, text: str = "text") -> DataFrame:
    """(doc_id, text, y, part) of labelled documents that aren't held out.

    ``part`` is "fit" or "calibrate"; a fifth of the ids (another remainder of
    the checksum) is for calibration. Of each class at most ``per_class`` rows
    are for fitting and ``calibration`` of both for calibrating, taken in the
    order of a hash of the id, so the sample is the same whatever the
    partitions. Ids that occur more than once count once (their least text and
    greatest label); null ids and labels don't count.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y")) \
        .withColumn("part", F.when(checksum == 1, "calibrate").otherwise("fit"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where(F.col("part") == "calibrate").orderBy(*first).limit(calibration)
    for y, n in per_class.items():
        chosen = chosen.unionByName(known.where((F.col("part") == "fit") & (F.col("y") == y)).orderBy(*first).limit(n))
    chosen = written(chosen, "chosen")  # at most sum(per_class) + calibration ids, so it may be broadcast
    got = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return written(got.groupBy("doc_id", "y", "part").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "sample")
