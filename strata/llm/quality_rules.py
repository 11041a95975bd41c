"""Quality rules with host verdicts.

Each document gets counts that its own text decides (``document_counts``) and
rules on them. Rule failures are then summed by host; the failure rate of a
host is shrunk towards the corpus by a beta prior whose two parameters are
fitted to the spread of the host rates (moments), so that small hosts aren't
judged by a few documents. A host whose shrunk rate is above ``max_rate`` is
held to the soft rules as well; elsewhere only the base rules reject.

Cases: a null or empty text has zero counts and fails the base rule (under 20
words). A null host is a host of its own. Repeated rows count each. An empty
table gives an empty result. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free_name, written

COUNTS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


def _repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` (a power of two) words found twice
    or more. Windows are compared exactly: ranks of pairs, then of fours, ..."""
    import numpy as np
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    width = 1
    while width < size:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
    again = (np.bincount(rank) > 1)[rank]
    if not again.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.subtract.at(edge, at + size, 1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def counts_of(text: bytes | None) -> dict:
    """Counts of one UTF-8 text; bytes.split() splits at exactly \\x20 \\x09-\\x0D."""
    text = text or b""
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    points = len(text.decode("utf-8", "replace"))
    return {"n_words": len(words), "word_chars": points - sum(text.count(bytes([c])) for c in SPACES),
            "n_symbols": sum(text.count(bytes([c])) for c in SYMBOLS), "n_dup_lines": dup,
            "n_repeat_words": _repeat_words(words)}


def document_counts(text: Column) -> Column:
    def run(texts):
        return [counts_of(t) for t in texts]
    return arrow_column(run, COUNTS)(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def soft_failed(m: Column) -> Column:
    """Rules that reject only under a bad host: symbols over a tenth of the
    words, over a fifth of the words' count in repeated lines, words whose mean
    length is outside 2 to 14 code points."""
    w = m["n_words"]
    return (10 * m["n_symbols"] > w) | (5 * m["n_dup_lines"] > w) | \
        (m["word_chars"] < 2 * w) | (m["word_chars"] > 14 * w)


def host_rates(checked: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, failures, rate): ``rate`` is the mean of the beta posterior.

    The prior comes from sums over hosts, so the driver gets one row.
    """
    hosts = written(checked.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")), "hosts")
    rate = F.col("failures") / F.col("n")
    row = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("h"),
                    F.avg(rate).alias("m"), F.var_pop(rate).alias("v"),
                    F.avg(1 / F.col("n")).alias("inv")).first()
    mean = (row["f"] + 1.0) / (row["n"] + 2.0) if row["n"] else 0.5
    # variance of host rates less what sampling alone gives; a small floor keeps the prior proper
    spread = max((row["v"] or 0.0) - mean * (1 - mean) * (row["inv"] or 0.0), 1e-6)
    weight = min(max(mean * (1 - mean) / spread - 1.0, 1.0), 1e6)
    return hosts.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("n") + weight))


def quality_rules(counted: DataFrame, counts: str = "counts", host: str = "source", max_rate: float = 0.5,
                  failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """``counted`` (documents with their struct of counts, without those columns
    that aren't wanted later) with the base verdict and ``kept``. The checked
    table is written once, as both the host sums and the result read it."""
    key, soft, bad = (free_name(counted, x) for x in ("__host", "__soft", "__bad"))
    checked = counted.withColumn(failed, base_failed(F.col(counts))) \
        .withColumn(soft, F.col(failed) | soft_failed(F.col(counts))) \
        .withColumn(key, F.coalesce(F.concat(F.lit("host "), F.col(host)), F.lit("no host")))
    checked = written(checked, "checked")
    # written, so that its size is known: a small one is broadcast, a large one shuffled
    verdicts = written(host_rates(checked, key, soft).where(F.col("rate") > max_rate)
                       .select(F.col("host").alias(key), F.lit(True).alias(bad)), "bad-hosts")
    return checked.join(verdicts, key, "left") \
        .withColumn(kept, ~F.col(failed) & ~(F.coalesce(F.col(bad), F.lit(False)) & F.col(soft))) \
        .drop(key, soft, bad)
