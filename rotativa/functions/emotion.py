"""Emotional style signals of one text: 5 base signals and 8 extra ones, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars, lexicons, tokens
from .numeric import floor_one, ratio
from .text import text_or_empty

BASE_NAMES = (
    "sig_exclam_ratio", "sig_question_ratio", "sig_uppercase_ratio", "sig_emoji_ratio", "sig_intensifier_ratio",
)
EXTRA_NAMES = (
    "sig_len_chars", "sig_len_tokens", "sig_punct_ratio", "sig_digit_ratio", "sig_repeat_exclam_ratio",
    "sig_repeat_question_ratio", "sig_elipsis_ratio", "sig_quote_ratio",
)


@dataclass(frozen=True)
class SignalConfig:
    per: str = "chars"
    extra: bool = True
    intensifiers: tuple[str, ...] = lexicons.INTENSIFIERS

    def __post_init__(self):
        if self.per not in ("chars", "tokens"):
            raise ValueError(f"per must be 'chars' or 'tokens', got {self.per!r}")
        object.__setattr__(self, "intensifiers", tuple(self.intensifiers or lexicons.INTENSIFIERS))

    @property
    def names(self) -> tuple[str, ...]:
        return BASE_NAMES + (EXTRA_NAMES if self.extra else ())


def with_signal_counts(df: DataFrame, text: str) -> DataFrame:
    """Add ``_em_*`` columns: the text, its words and its word skeletons."""
    t, skeleton, marked = (F.col(f"_em_{name}") for name in ("text", "skeleton", "marked"))
    return (
        df.withColumn("_em_text", text_or_empty(F.col(text)))
        .withColumns({
            "_em_words": tokens.signal_words(t),
            "_em_skeleton": chars.word_skeleton(t),
            "_em_marked": chars.marked_only(t),
        })
        .withColumns({
            "_em_dense": chars.drop_spaces(skeleton),
            "_em_numbers": chars.numbers_only(marked),
            "_em_upper": chars.count_upper(marked),
        })
        .withColumn("_em_emoji", chars.count_emoji(t, F.col("_em_dense")))
    )


def signal_features(config: SignalConfig = SignalConfig()) -> dict[str, Column]:
    text, words, skeleton, dense, numbers, emoji = (
        F.col(f"_em_{name}") for name in ("text", "words", "skeleton", "dense", "numbers", "emoji")
    )
    n_chars, n_words = F.length(text), F.size(words)
    per = n_chars if config.per == "chars" else n_words
    found = {
        "sig_exclam_ratio": ratio(chars.count_char(dense, "!"), per),
        "sig_question_ratio": ratio(chars.count_char(dense, "?"), per),
        "sig_uppercase_ratio": ratio(F.col("_em_upper"), chars.count_letters(text, skeleton, numbers)),
        # Most texts have no emoji, and then nobody needs to count chunks.
        "sig_emoji_ratio": F.when(emoji > 0, ratio(emoji, tokens.chunk_count(skeleton))).otherwise(0.0),
        "sig_intensifier_ratio": ratio(
            F.size(F.filter(words, lambda w: w.isin(*config.intensifiers))), n_words
        ),
        "sig_len_chars": floor_one(n_chars).cast("double"),
        "sig_len_tokens": floor_one(n_words).cast("double"),
        "sig_punct_ratio": ratio(chars.count_punctuation(text, dense), n_chars),
        "sig_digit_ratio": ratio(chars.count_digits(numbers), n_chars),
        "sig_repeat_exclam_ratio": ratio(F.regexp_count(skeleton, F.lit("!{2,}")), per),
        "sig_repeat_question_ratio": ratio(F.regexp_count(skeleton, F.lit(r"\?{2,}")), per),
        "sig_elipsis_ratio": ratio(F.regexp_count(skeleton, F.lit(r"\.{3,}")), per),
        "sig_quote_ratio": ratio(chars.count_quotes(dense), n_chars),
    }
    return {name: found[name] for name in config.names}
