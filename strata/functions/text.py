"""Per-document text statistics used as the classification feature table.

Only explicit ASCII classes are used: POSIX/Unicode classes differ between
regex engines, and these columns are checked against an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes of the feature definitions
UPPER_CLASS = "[^A-Z]"
PUNCT_CLASS = "[^!-/:-@]"
DIGIT_CLASS = "[^0-9]"
WORD_SPLIT = "[\\W_]+"  # [^A-Za-z0-9]+, which Java's matcher takes six times as long for


def _count_class(text: Column, keep_not: str) -> Column:
    # a match a run of other characters, not one a character
    return F.length(F.regexp_replace(text, keep_not + "+", ""))


def normalised_words(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs (array<string>, no empty tokens)."""
    norm = F.lower(F.regexp_replace(text, WORD_SPLIT, " "))
    return F.array_remove(F.split(norm, " "), "")


def upper_ratio(text: Column, n_chars: Column) -> Column:
    return _count_class(text, UPPER_CLASS) / F.greatest(n_chars, F.lit(1))


def punct_ratio(text: Column, n_chars: Column) -> Column:
    return _count_class(text, PUNCT_CLASS) / F.greatest(n_chars, F.lit(1))


def digit_ratio(text: Column, n_chars: Column) -> Column:
    return _count_class(text, DIGIT_CLASS) / F.greatest(n_chars, F.lit(1))


def type_token_ratio(words: Column) -> Column:
    return F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def mean_word_length(text: Column, words: Column) -> Column:
    """Letters and digits of ``text`` by the number of its ``words``."""
    return F.length(F.regexp_replace(text, WORD_SPLIT, "")) / F.greatest(F.size(words), F.lit(1))


def word_band(words: Column) -> Column:
    """Log2 word-count band from 1 (= bit length of the count, 1 for no words)."""
    n = F.size(words).cast("long")
    return F.greatest(F.lit(1), F.length(F.bin(n))).cast("int")
