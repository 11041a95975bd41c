"""Classification table (features A..I + target) from ``documents`` ⋈ ``labels``.

A upper-case ratio, B punctuation ratio, C ``'+'`` for English else ``'-'``,
D ``log1p(n_chars)``, E ``1 + source_number % 3`` (NULL when ``doc_id % 12 = 0``),
F log2 word-count band, G type-token ratio, H digit ratio, I mean word length;
``target = 1 - quality`` (low quality is the minority, positive class).
Unlabelled documents (anti-join) form the test table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.util import stored
from ..sources.tables import Tables

KEY = "doc_id"
FEATURES = ["A", "B", "C", "D", "E", "F", "G", "H", "I"]
NUMERIC = ["A", "B", "D", "E", "F", "G", "H", "I"]


def features(documents: DataFrame) -> DataFrame:
    words = T.normalised_words(F.col("text"))
    n = F.col("n_chars")
    d = documents.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_w", words)
    return d.select(
        F.col("doc_id"),
        T.upper_ratio(F.col("text"), n).alias("A"),
        T.punct_ratio(F.col("text"), n).alias("B"),
        F.when(F.col("lang") == "en", F.lit("+")).otherwise(F.lit("-")).alias("C"),
        F.log1p(n.cast("double")).alias("D"),
        F.when(F.col("doc_id") % 12 == 0, F.lit(None).cast("int"))
         .otherwise(1 + F.substring("source", 4, 8).cast("int") % 3).alias("E"),
        T.word_band(F.col("_w")).alias("F"),
        T.type_token_ratio(F.col("_w")).alias("G"),
        T.digit_ratio(F.col("text"), n).alias("H"),
        T.mean_word_length(F.col("text"), F.col("_w")).alias("I"),
    )


def train_table(t: Tables) -> DataFrame:
    """Labelled rows with ``target``. labels is keyed by doc_id (unique)."""
    return _labelled(features(t.documents), t)


def _labelled(feats: DataFrame, t: Tables) -> DataFrame:
    return feats.join(t.labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("target")), "doc_id", "inner")


def tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) rows; the text is read once and the features are
    written, as both sides and every fold read them."""
    feats = stored(features(t.documents), "features")
    return _labelled(feats, t), feats.join(t.labels.select("doc_id"), "doc_id", "left_anti")


def targets(t: Tables) -> DataFrame:
    """(doc_id, target) of the labelled documents; no text is read."""
    return _labelled(t.documents.select("doc_id"), t)


def test_table(t: Tables) -> DataFrame:
    return features(t.documents).join(t.labels.select("doc_id"), "doc_id", "left_anti")


# SQL twin of ``features`` for the DuckDB oracle (same definitions, same classes).
FEATURES_SQL = r"""
  select doc_id,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(n_chars, 1) as A,
    length(regexp_replace(text, '[^!-/:-@]', '', 'g')) / greatest(n_chars, 1) as B,
    case when lang = 'en' then '+' else '-' end as C,
    ln(1 + cast(n_chars as double)) as D,
    case when doc_id % 12 = 0 then null
         else cast(1 + cast(substr(source, 4, 8) as integer) % 3 as integer) end as E,
    cast(greatest(1, length(bin(cast(len(_w) as bigint)))) as integer) as F,
    len(list_distinct(_w)) / greatest(len(_w), 1) as G,
    length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(n_chars, 1) as H,
    coalesce(list_sum(list_transform(_w, lambda w: length(w))), 0) / greatest(len(_w), 1) as I
  from (select *, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '),
                              lambda w: w <> '') as _w from documents) d
"""

TRAIN_SQL = f"""
  (select f.*, cast(1 - l.quality as integer) as target
   from ({FEATURES_SQL}) f join labels l using (doc_id))
"""

TEST_SQL = f"""
  (select f.* from ({FEATURES_SQL}) f where doc_id not in (select doc_id from labels))
"""
