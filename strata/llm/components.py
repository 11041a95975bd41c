"""Connected components of an edge table, by joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.util import discard, recording
from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): ``label`` is the smallest node of the component.

    Every round lowers each node's label to the least label among its
    neighbours, hooks whole trees onto the least label that any of their nodes
    saw, and halves the paths to the roots, so that the number of rounds is
    logarithmic in the diameter. Each round is written to the shared folder.
    A hub (a node or label with very many rows) only meets joins against unique
    keys, which adaptive execution splits, and aggregates that combine before
    the shuffle. A round's tables are deleted when the next is written.

    Cases: edges with a null end and loops are dropped, so a node without
    another neighbour has no row. Repeated edges count once. No edges, no rows.
    Extra columns aren't read; ``a`` and ``b`` name those that are.
    """
    spark = edges.sparkSession
    with recording() as old:
        label, linked = start(edges, a, b)
    while True:
        with recording() as made:
            new = lowered(label, linked)
        label = new.select("node", "label")
        done = new.where("moved").isEmpty()
        # the links stay until the labels do; of a round only its labels do
        discard(spark, [*old[1:], *made[:-1]])
        old = [old[0], made[-1]]
        if done:
            discard(spark, old[:1])
            return label


def start(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """First labels and the links in both directions, the first table written."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
                   .where("node <> other").distinct(), "links")
    label = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    return label, both


def lowered(label: DataFrame, both: DataFrame) -> DataFrame:
    """(node, label, moved) after a round, the last table written."""
    other = label.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
    seen = both.join(other, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
    near = written(label.join(seen, "node").select(
        "node", "label", F.least("label", "theirs").alias("near")), "near")
    hooks = near.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
    step = written(near.join(hooks, "node", "left").select(
        "node", F.col("label").alias("old"),
        F.least("near", F.coalesce("hook", "near")).alias("label")), "hooked")
    root = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return written(step.join(root, "label").select(
        "node", F.least("label", "root").alias("label"),
        (F.col("old") != F.least("label", "root")).alias("moved")), "labels")
