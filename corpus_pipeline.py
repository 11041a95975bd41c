"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``docs``, whatever these are
beside doc_id, text and source; the last returns the packed pieces. ``run``
writes what a stage returns and reads it again for the next, so a lost
executor costs no finished stage. What a stage wrote for itself is deleted
when a later stage starts on a table that doesn't read it.

Cases, in every stage: a null text counts as empty; null or repeated ids,
sources and rows are rows of their own; ties are broken by the row; an empty
table gives an empty one; texts of any length are read whole; columns of any
name stay as they are (``packing`` returns its own columns only).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import quality_model, quality_rules as rules, secrets, simhash
from strata.llm.common import free_name, table, written
from strata.llm.queries import packed
from strata.operators.util import discard, recording
from strata.plans.registry import query
from strata.session import ensure_checkpoint_dir

#: Score below which a document is rejected.
MIN_QUALITY = 0.3


#: Tables that stages wrote for themselves, by application and place of the stage.
_left: dict[tuple[str, int], list[str]] = {}


def clear(spark: SparkSession, upto: int, docs: DataFrame) -> None:
    """Delete what the stages before ``upto`` left, unless ``docs`` reads it."""
    app = spark.sparkContext.applicationId
    reads = docs.inputFiles()
    for key in [k for k in _left if k[0] == app and k[1] < upto]:
        gone = [p for p in _left[key] if not any(p in f for f in reads)]
        discard(spark, gone)
        _left[key] = [p for p in _left[key] if p not in gone]


def stage(place: int) -> Callable:
    """A stage that cleans up after the stages before it and records its own tables."""
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            clear(spark, place, docs)
            with recording() as made:
                out = fn(spark, docs, sf_dir)
            _left.setdefault((spark.sparkContext.applicationId, place), []).extend(made)
            return out
        return run
    return deco


@stage(0)
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``MIN_QUALITY``."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return docs.withColumn(name, quality_model.score(F.col("text"), model)) \
        .where(F.col(name) >= MIN_QUALITY).select(*docs.columns)


@stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, with the verdict on their host, keep."""
    counts, failed, kept = (free_name(docs, x) for x in ("__counts", "__failed", "__kept"))
    counted = docs.withColumn(counts, rules.document_counts(F.col("text")))
    return rules.quality_rules(counted, counts, failed=failed, kept=kept).where(F.col(kept)).select(*docs.columns)


@stage(2)
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id
    (of equal ids one row; a null id only if the group has no other)."""
    fp, row = free_name(docs, "__fp"), free_name(docs, "__row")
    # numbered as written: later reads see the same numbers
    marked = written(docs.withColumn(fp, simhash.fingerprint(F.col("text")))
                     .withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = simhash.near_duplicates(slim).groupBy("component_fp").agg(first["row"].alias(row)).select(row)
    # a merge join at every size: the list of rows grows with the documents, so it is never broadcast
    return marked.join(written(stay, "stay").hint("merge"), row, "left_semi").select(*docs.columns)


@stage(3)
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; n_chars follows."""
    found = free_name(docs, "__found")
    clean = secrets.redact(secrets.secret_spans(docs, "text", found), "text", found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


@stage(4)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, ids included, with their places in the sequences."""
    return packed(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup),
          ("secret_scan", secret_scan), ("packing", packing)]

#: SQL has no form of the classifier, of fingerprints or of packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES:
        with recording() as made:
            docs = written(apply(spark, docs, sf_dir), name)
        # its own tables and its input have served
        clear(spark, len(STAGES), docs)
        discard(spark, before)
        before = made[-1:]
    return docs


def register() -> None:
    """Add the query ``pipeline`` to the registry."""
    query("pipeline", ORACLE_SQL)(run)
