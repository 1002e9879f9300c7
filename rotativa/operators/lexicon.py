"""Word frequencies from a corpus, and how many words of a text are rare in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.numeric import ratio
from ..functions.text import normalize_text
from ..session import stored
from .corpus import ID
from .skew import BROADCAST_ROWS, is_small, salted_join

PER_BILLION = 1e9
HOT_WORDS = 1_000  # the most frequent words of a lexicon that is shuffled: they make up most of a text and need no shuffle


def zipf_lexicon(df: DataFrame, text: str) -> DataFrame:
    """``word, n, zipf`` where zipf is log10 of occurrences per billion words.

    Words are counted map-side before the shuffle, and set in lower case after they are told apart, outside of a lambda. The
    counts are stored: a filter on words would otherwise go down into them, but not into those of the total, and all words
    would be counted twice.
    """
    words = df.select(F.explode(tokens.words(normalize_text(F.col(text)))).alias("word"))
    counts = stored(words.select(F.lower("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.select("word", "n", F.log10(F.col("n") / total * F.lit(PER_BILLION)).alias("zipf"))


def is_rare(word: Column, zipf: Column, below: float) -> Column:
    """Only all-letter words can be rare; a word the lexicon lacks has zipf 0."""
    return word.rlike(r"^\p{L}+$") & (F.coalesce(zipf, F.lit(0.0)) < F.lit(float(below)))


def rare_share(
    words: DataFrame, lexicon: DataFrame, below: float, keys: Sequence[str], word: str,
    broadcast_rows: int = BROADCAST_ROWS, language: str | None = None, marks: Sequence[str] = (),
) -> DataFrame:
    """``keys, n_words, n_rare, error_rate`` from one row per word occurrence (a null word stands for a text without).
    ``marks`` are numbers to be added up beside them. The words are read more than once: keys have to be the same each time.

    Only frequent words of the lexicon can change the outcome, so only those are joined; they are stored, so that the
    lexicon runs once. Of a lexicon too big to broadcast the ``HOT_WORDS`` most frequent are, all other words of letters
    are shuffled once, by word, and those found are taken from the rare ones. With ``language``
    the lexicon has a column of that name, and a word counts in the language of its text.
    """
    of_language = [language] if language else []
    on = [word, *of_language]
    listed = lexicon.filter(F.col("zipf") >= F.lit(float(below))).select(F.col("word").alias(word), *of_language, "zipf")
    known = stored(listed, "lexicon")
    per_word = words.select(*keys, *on, *marks, F.lit(1).cast("long").alias("_n"))
    w = F.col(word)
    if is_small(known, broadcast_rows):
        joined = per_word.join(F.broadcast(known), on, "left")
        counted = joined.select(
            *keys, *marks, F.when(w.isNotNull(), F.col("_n")).alias("_words"), F.when(is_rare(w, F.col("zipf"), below), F.col("_n")).alias("_rare")
        )
    else:
        hot = F.broadcast(stored(known.orderBy(F.desc("zipf"), *on).limit(HOT_WORDS).select(*on, "zipf"), "hot-words"))
        open_ = is_rare(w, F.col("zipf"), below)
        first = per_word.join(hot, on, "left").select(
            *keys, *marks, F.when(w.isNotNull(), F.col("_n")).alias("_words"), F.when(open_, F.col("_n")).alias("_rare")
        )
        cold = per_word.drop(*marks).filter(is_rare(w, F.lit(None).cast("double"), below)).join(hot.select(*on), on, "left_anti")
        found = salted_join(cold, known.select(*on).hint("shuffle_hash"), on, "inner", list(keys))
        nothing = [F.lit(0).cast("long").alias(name) for name in (*marks, "_words")]
        counted = first.unionByName(found.select(*keys, *nothing, (-F.col("_n")).alias("_rare")))
    sums = [F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(f"n_{name}") for name in ("words", "rare")] + [F.sum(name).alias(name) for name in marks]
    return counted.groupBy(*keys).agg(*sums).withColumn("error_rate", ratio(F.col("n_rare"), F.col("n_words")))


def oov_rate(
    df: DataFrame, text: str, lexicon: DataFrame, below: float = 1.5, id_col: str = ID,
    broadcast_rows: int = BROADCAST_ROWS, language: str | None = None,
) -> DataFrame:
    """``id, n_words, n_rare, error_rate`` of every row; repeated and null ids keep their own rates.

    Rows that share id, text and language are counted together and come back as many.
    """
    keyed = df.withColumn("_text", text_key(text))
    if language:
        keyed = keyed.withColumn("_of", F.col(language))
    keys = [id_col, "_text", *(["_of"] if language else [])]
    split = tokens.lower_words(normalize_text(F.col(text)))
    words = keyed.select(*keys, *([language] if language else []), F.posexplode_outer(split).alias("_at", "_word"))
    marked = words.withColumn("_rows", (F.coalesce("_at", F.lit(0)) == 0).cast("long"))  # each row's first word
    rates = rare_share(marked, lexicon, below, keys, "_word", broadcast_rows, language, ["_rows"])
    each = [F.expr(f"{name} div _rows").alias(name) for name in ("n_words", "n_rare")]
    return rates.select(id_col, *each, "error_rate", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy")).drop("_copy")


def text_key(text: str) -> Column:
    """Stands for a text beside its id: what depends on the text alone is the same for rows that share both."""
    return F.xxhash64(normalize_text(F.col(text)))


def exploded_words(df: DataFrame, text: str, keys: Sequence[str], language: str | None = None) -> DataFrame:
    words = tokens.lower_words(normalize_text(F.col(text)))
    return df.select(*keys, *([language] if language else []), F.explode_outer(words).alias("_word"))
