"""Words, symbols and sentences as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import NON_SPACE_CHAR, WORD, count_char, drop_spaces, strip, word_skeleton

SENTENCE_END = "[.!?]+"


def words(c: Column) -> Column:
    """Runs of letters, numbers and ``_``."""
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0))


def lower_words(c: Column) -> Column:
    """Words first, lower case second: the other order can split a word (dotted capital I)."""
    return F.transform(words(c), F.lower)


def signal_words(c: Column) -> Column:
    return words(F.lower(c))


def symbols(c: Column) -> Column:
    """Words and every other single character that is no space, in text order."""
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+|{NON_SPACE_CHAR}"), F.lit(0))


def chunk_count(c: Column) -> Column:
    """Number of chunks between spaces."""
    return F.regexp_count(c, F.lit(f"{NON_SPACE_CHAR}+"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def dense_sentences(dense_skeleton: Column) -> Column:
    """Non-empty sentences of a word skeleton without spaces: one ``w`` per word, symbols as they are."""
    return F.filter(F.split(dense_skeleton, SENTENCE_END), lambda s: s != "")


def words_per_sentence(dense: Column) -> Column:
    return F.transform(dense, lambda s: count_char(s, "w"))


def sentence_lengths(c: Column) -> Column:
    """Words per sentence; a sentence of symbols only counts, with 0 words."""
    return words_per_sentence(dense_sentences(drop_spaces(word_skeleton(c))))
