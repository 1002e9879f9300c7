"""Style features that one text alone determines, staged so that each pass over the text runs once.

``with_style_counts`` adds counts in a few projections; Spark keeps them apart because a later stage reads an
expensive column more than once. ``core_features`` and ``signal_features`` are arithmetic over those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars, lexicons, tokens
from .numeric import floor_one, ratio
from .text import normalize_text

POS_RATIOS = {
    "pos_noun_ratio": ("NOUN", "PROPN"),
    "pos_verb_ratio": ("VERB", "AUX"),
    "pos_adj_ratio": ("ADJ",),
    "pos_adv_ratio": ("ADV",),
    "pos_pron_ratio": ("PRON",),
    "pos_det_ratio": ("DET",),
    "pos_adp_ratio": ("ADP",),
}

CORE_NAMES = (
    "ifsz", "formality_f", "len_sent", "sconj_per_sent", "avg_dep_depth", "verbs_per_sent",
    "ttr", "redundancy", "herdans_c", "root_ttr", *POS_RATIOS, "error_rate",
)

SIGNAL_NAMES = (
    "sig_punct_ratio", "sig_excl_per_sent", "sig_q_per_sent", "sig_ellipsis_per_sent", "sig_quotes_ratio",
    "sig_uppercase_ratio", "sig_repeated_char_ratio", "sig_avg_word_len", "sig_long_word_ratio",
    "sig_stopword_ratio", "sig_digit_ratio", "sig_percent_ratio", "sig_intensifier_ratio", "sig_se_per_sent",
    "sig_hedge_ratio", "sig_proper_like_ratio", "sig_burstiness",
)

# readability = base - per_syllable * syllables/words - words/sentences.
READABILITY_BASE = 206.835
READABILITY_PER_SYLLABLE = 62.3

# Vowel groups of Spanish: an accented weak vowel stands alone, a strong vowel takes weak neighbours with it.
SYLLABLE = "(?=[aeiouáéíóúü])(?:[aeoáéó][iuü]*|[iuü]+(?:[aeoáéó][iuü]*)?|[íú])"


@dataclass(frozen=True)
class StyleConfig:
    readability: bool = True
    formality: bool = True
    rare_words: bool = True
    diversity: bool = True
    extra_signals: bool = True
    rare_below_zipf: float = 1.5
    stopwords: tuple[str, ...] = lexicons.STOPWORDS
    intensifiers: tuple[str, ...] = lexicons.INTENSIFIERS

    def __post_init__(self):
        for name in ("stopwords", "intensifiers"):
            given = getattr(self, name) or getattr(lexicons, name.upper())
            object.__setattr__(self, name, tuple(sorted(set(given))))

    @property
    def names(self) -> tuple[str, ...]:
        return CORE_NAMES + (SIGNAL_NAMES if self.extra_signals else ())


def _hits(words: Column, wanted) -> Column:
    """How many words are in a fixed list. ``isin`` on literals becomes one hash-set test per word."""
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def is_long(word: Column) -> Column:
    return F.length(word) >= lexicons.LONG_WORD


def syllables(c: Column) -> Column:
    """Vowel groups, counted by the length of a string of marks."""
    return chars.count_char(F.regexp_replace(F.lower(c), SYLLABLE, "\x01"), "\x01")


def with_style_counts(df: DataFrame, text: str, config: StyleConfig = StyleConfig(), signals: bool = False) -> DataFrame:
    """Add ``_st_*`` count columns. The caller selects what it needs, the optimizer drops the rest.

    ``signals``: ``with_signal_counts`` has added its columns for the same text. What spaces at its ends don't change is
    taken from there instead of being searched for again.
    """
    listed = sorted({*config.stopwords, *config.intensifiers, *lexicons.HEDGES, *lexicons.SUBORDINATORS,
                     lexicons.IMPERSONAL})
    t, skeleton, dense, marked, numbers = (F.col(f"_st_{name}") for name in ("text", "skeleton", "dense", "marked", "numbers"))
    whole = F.col("_em_text") if signals else t
    return (
        df.withColumn("_st_text", normalize_text(F.col(text)))
        .withColumns({
            "_st_words": tokens.lower_words(t),
            "_st_skeleton": F.col("_em_skeleton") if signals else chars.word_skeleton(t),
            "_st_marked": F.col("_em_marked") if signals else chars.marked_only(t),
        })
        .withColumns({
            "_st_dense": F.col("_em_dense") if signals else chars.drop_spaces(skeleton),
            "_st_numbers": F.col("_em_numbers") if signals else chars.numbers_only(marked),
            "_st_chars": F.length(t),
            "_st_n_words": chars.count_char(skeleton, "w"),
            "_st_n_distinct": F.size(F.array_distinct("_st_words")),
            "_st_word_chars": F.length(F.array_join("_st_words", "")),
            # One pass over all words; lists and lengths are then told apart among the few that are left.
            "_st_notable": F.filter("_st_words", lambda w: is_long(w) | w.isin(*listed)),
            "_st_upper": F.col("_em_upper") if signals else chars.count_upper(marked),
            "_st_repeats": F.regexp_count(t, F.lit(r"(?d)(.)\1\1+")),
            "_st_syllables": syllables(t),
        })
        .withColumns({
            "_st_letters": chars.count_letters(whole, skeleton, numbers),
            "_st_digits": chars.count_digits(numbers),
            "_st_punct": chars.count_punctuation(t, dense),
            "_st_lengths": tokens.words_per_sentence(tokens.dense_sentences(dense)),
        })
    )


def sentence_count() -> Column:
    return floor_one(F.size("_st_lengths"))


def readability(config: StyleConfig) -> Column:
    if not config.readability:
        return F.lit(0.0)
    n_words = floor_one(F.col("_st_n_words"))
    return (
        F.lit(READABILITY_BASE)
        - F.lit(READABILITY_PER_SYLLABLE) * ratio(floor_one(F.col("_st_syllables")), n_words)
        - ratio(n_words, sentence_count())
    )


def diversity(distinct: Column, n_words: Column, config: StyleConfig) -> dict[str, Column]:
    ttr = ratio(distinct, n_words)
    out = {"ttr": ttr, "redundancy": F.lit(1.0) - ttr, "herdans_c": F.lit(0.0), "root_ttr": F.lit(0.0)}
    if config.diversity:
        out["herdans_c"] = F.ln(floor_one(distinct)) / F.greatest(F.ln(floor_one(n_words)), F.lit(1e-8))
        out["root_ttr"] = distinct / F.sqrt(floor_one(n_words))
    return out


def core_features(config: StyleConfig = StyleConfig(), error_rate: Column | None = None) -> dict[str, Column]:
    """The 18 core features without part-of-speech tags; those that need tags are 0."""
    n_words = F.col("_st_n_words")
    found = {
        "ifsz": readability(config),
        "len_sent": n_words / sentence_count(),
        "sconj_per_sent": _hits(F.col("_st_notable"), lexicons.SUBORDINATORS) / sentence_count(),
        **diversity(F.col("_st_n_distinct"), n_words, config),
    }
    if error_rate is not None:
        found["error_rate"] = error_rate
    return {name: found.get(name, F.lit(0.0)) for name in CORE_NAMES}


def burstiness() -> Column:
    """Population deviation of words per sentence, from integer sums."""
    n = F.size("_st_lengths").cast("double")
    total = F.aggregate("_st_lengths", F.lit(0).cast("long"), lambda acc, x: acc + x)
    squares = F.aggregate("_st_lengths", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    return F.when(n > 0, F.sqrt(n * squares - total * total) / n).otherwise(0.0)


def text_signals(n_sentences: Column) -> dict[str, Column]:
    """Signals that depend on characters and on the number of sentences, not on how words are told apart."""
    skeleton, dense = F.col("_st_skeleton"), F.col("_st_dense")
    n_chars = F.col("_st_chars")
    return {
        "sig_punct_ratio": ratio(F.col("_st_punct"), n_chars),
        "sig_excl_per_sent": chars.count_char(dense, "!") / n_sentences,
        "sig_q_per_sent": chars.count_char(dense, "?") / n_sentences,
        "sig_ellipsis_per_sent": F.regexp_count(skeleton, F.lit(r"\.{3,}")) / n_sentences,
        "sig_quotes_ratio": ratio(chars.count_quotes(dense), n_chars),
        "sig_uppercase_ratio": ratio(F.col("_st_upper"), F.col("_st_letters")),
        "sig_repeated_char_ratio": ratio(F.col("_st_repeats"), n_chars),
        "sig_digit_ratio": ratio(F.col("_st_digits"), n_chars),
        "sig_percent_ratio": ratio(chars.count_char(dense, "%"), n_chars),
        "sig_burstiness": burstiness(),
    }


def signal_features(config: StyleConfig = StyleConfig()) -> dict[str, Column]:
    n_words = F.col("_st_n_words")
    notable = F.col("_st_notable")
    found = {
        **text_signals(sentence_count()),
        "sig_avg_word_len": ratio(F.col("_st_word_chars"), n_words),
        "sig_long_word_ratio": ratio(F.size(F.filter(notable, is_long)), n_words),
        "sig_stopword_ratio": ratio(_hits(notable, config.stopwords), n_words),
        "sig_intensifier_ratio": ratio(_hits(notable, config.intensifiers), n_words),
        "sig_se_per_sent": _hits(notable, [lexicons.IMPERSONAL]) / sentence_count(),
        "sig_hedge_ratio": ratio(_hits(notable, lexicons.HEDGES), n_words),
        "sig_proper_like_ratio": F.lit(0.0),
    }
    return {name: found[name] for name in SIGNAL_NAMES}
