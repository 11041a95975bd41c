"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. The shorter word (either, if equal) contributes two disjoint chunks,
its halves; one edit lies within one of them and preserves the other. The other
word contributes positional grams: of all of them only those can equal a chunk
that lie at its place (before the edit) or, in a word longer by one, one place
on (after it), so these are made. Equal chunk and gram is a candidate, which the
edit distance verifies.

A chunk that more than ``CROWD`` rows share (a common beginning or end) would
make all pairs of its words. For these rows the lemma is applied to what the
chunk leaves open: it is halved, one of the halves is preserved too, and the
chunk grows by it, until a chunk has few rows or leaves one code point open. At
that a chunk has at most as many words as there are letters and a gram as many
as there are pairs of letters, so no group is unbounded. The size of the open
part, never its share of the words, ends the refinement, and no row is dropped.

Cases: null texts have no words. Repeated texts count again. Words of any length
take part. Ties in frequency go to the smaller word in code-point order. An
empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.util import broadcast_if_small, discard, recording
from .common import written

CROWD = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, least: int = 7, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, run): the maximal runs of letters of at least ``least`` code
    points, A-Z in lower case. A greedy match starts where a run does, so
    shorter runs are never part of one."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select(*keep, F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, UPPER.lower()))


def dropped_letter(run: Column, salt: Column, every: int = 31) -> Column:
    """``run``, without the code point h % length where h, the checksum of
    ``salt``:``run``, is divisible by ``every`` (a null salt is empty)."""
    h = F.crc32(F.concat(F.coalesce(salt.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, word: str = "word", least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur often enough."""
    return words.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")) \
        .where((F.col("n") >= occurrences) & (F.char_length("word") >= least))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, a hash of the code points that ``lo`` to ``hi`` leaves; in
    a gram (a word longer by one) the open part is one longer."""
    rest = F.col("hi") + F.col("gram").cast("int")
    return rows.withColumn("key", F.xxhash64(
        "length", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
        F.substring("word", rest + 1, F.char_length("word"))))


def halves(rows: DataFrame) -> DataFrame:
    """Two rows for each: either half of what was open stays open."""
    middle = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
    cut = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("word", "n", "length", "gram", F.explode(cut).alias("cut")) \
        .select("word", "n", "length", "gram", "cut.lo", "cut.hi")


def near_words(words: DataFrame, least: int = 7, crowd: int = CROWD) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of ``words`` (a written table of
    distinct (word, n)) once, in a written table."""
    spark = words.sparkSession
    length = F.char_length("word")
    as_chunk = words.select("word", "n", length.alias("length"), F.lit(False).alias("gram"))
    as_gram = words.where(length > least).select("word", "n", (length - 1).alias("length"), F.lit(True).alias("gram"))
    whole = as_chunk.unionByName(as_gram).withColumn("lo", F.lit(0)).withColumn("hi", F.col("length"))
    with recording() as made:
        rows = written(keyed(halves(whole)), "chunks")
        ready = []
        while True:
            crowded = written(rows.where("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
                              .where(F.col("rows") > crowd).select("key", F.lit(True).alias("crowded")), "crowded")
            told = rows.join(broadcast_if_small(crowded), "key", "left")
            ready.append(told.where("crowded is null").drop("crowded"))
            if crowded.isEmpty():
                break
            rows = written(keyed(halves(told.where("crowded").drop("key", "crowded"))), "chunks")
        all_rows = ready[0]
        for r in ready[1:]:
            all_rows = all_rows.unionByName(r)
        all_rows = written(all_rows.select("key", "word", "n", "gram"), "ready")
        a = all_rows.where("not gram").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = all_rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "gram")
        # equal lengths meet twice, and once is enough; words with several places for one edit share several chunks
        same = a.join(b, "key").where((F.col("gram") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        pairs = written(same.select("a", "a_n", "b", "b_n").distinct(), "near-words")
    discard(spark, made[:-1])
    return pairs


def variants(words: DataFrame, least: int = 7, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (distinct
    words of at least ``least`` code points with their frequency ``n``, written).

    ``form`` is the near word of greatest n, if that is at least ``factor``
    times the word's own. Each step to a form multiplies n, so that chains have
    at most log(n) steps and half as many after each round of jumps."""
    pairs = near_words(words, least)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    known = words.join(best, "word", "left").withColumn("top", -F.col("best.less"))
    strong = F.col("top") >= factor * F.col("n")
    formed = written(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, F.col("top")).alias("form_n")), "forms")
    jump = formed.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        on = jump.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"),
                                                          F.col("next").isNotNull().alias("moved")), "roots")
        moved = not jump.where("moved").isEmpty()
        jump = jump.select("word", "to")
        if not moved:
            break
    return formed.join(jump, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
