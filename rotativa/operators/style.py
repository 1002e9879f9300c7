"""Style block: 18 core features and 17 signals, with or without token annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import style as st
from ..functions.numeric import floor_one, ratio
from ..functions.style import StyleConfig
from . import annotations as ann
from .corpus import ID, require_columns
from .lexicon import exploded_words, rare_share, text_key


def style_features(
    df: DataFrame, text: str = "Text", config: StyleConfig = StyleConfig(), tokens: DataFrame | None = None,
    lexicon: DataFrame | None = None, id_col: str = ID,
) -> DataFrame:
    """``id`` and one column per feature, in the order of ``config.names``.

    Without tokens and lexicon everything is row-local: no shuffle. A lexicon adds one join of small rows by id;
    tokens add their aggregates, joined by id the same way.
    """
    require_columns(df, [id_col, text])
    use_lexicon = lexicon is not None and config.rare_words
    if tokens is None:
        out = _from_text(df, text, config, id_col, use_lexicon)
        if use_lexicon:
            words = exploded_words(df.withColumn("_text", text_key(text)), text, [id_col, "_text"])
            rates = rare_share(words, lexicon, config.rare_below_zipf, [id_col, "_text"], "_word")
            same = out[id_col].eqNullSafe(F.col("_id")) & (out["_text"] == F.col("_key"))
            found = rates.select(F.col(id_col).alias("_id"), F.col("_text").alias("_key"), F.col("error_rate").alias("_rate"))
            out = out.join(found, same, "left").withColumn("error_rate", F.coalesce("_rate", F.lit(0.0)))
    else:
        out = _from_tokens(df, text, tokens, config, id_col)
        if use_lexicon:
            words = tokens.filter(~F.col("is_space") & F.col("is_alpha")).select(
                id_col, F.lower("text").alias("_word")
            )
            rates = rare_share(words, lexicon, config.rare_below_zipf, [id_col], "_word")
            found = rates.select(id_col, F.col("error_rate").alias("_rate"))
            out = out.join(found, id_col, "left").withColumn("error_rate", F.coalesce("_rate", F.lit(0.0)))
    return out.select(id_col, *config.names)


def _from_text(df: DataFrame, text: str, config: StyleConfig, id_col: str, keyed: bool) -> DataFrame:
    columns = st.core_features(config) | (st.signal_features(config) if config.extra_signals else {})
    counted = st.with_style_counts(df.select(id_col, text), text, config)
    key = [text_key(text).alias("_text")] if keyed else []
    return counted.select(id_col, *key, *[c.alias(name) for name, c in columns.items()])


def _from_tokens(df: DataFrame, text: str, tokens: DataFrame, config: StyleConfig, id_col: str) -> DataFrame:
    """Characters come from the text, words, tags and sentences from the annotations.

    Per-sentence signals need the sentence count of the annotations, so the text side hands over plain counts
    (the signals for one sentence), which are divided after the join.
    """
    counted = st.with_style_counts(df.select(id_col, text), text, config)
    of_text = {"ifsz": st.readability(config)} | st.text_signals(F.lit(1))
    facts = counted.select(id_col, *[c.alias(f"_t_{name}") for name, c in of_text.items()])
    joined = facts.join(ann.token_stats(tokens, config, id_col), id_col, "left")

    def n(*names: str):
        total = F.lit(0)
        for name in names:
            total = total + F.coalesce(F.col(f"n_{name.lower()}"), F.lit(0))
        return total

    sents, n_tokens, n_words = floor_one(n("sents")), n("tokens"), n("words")
    found = {
        "ifsz": F.col("_t_ifsz"),
        "formality_f": F.lit(0.0),
        "len_sent": n_tokens / sents,
        "sconj_per_sent": n("SCONJ") / sents,
        "avg_dep_depth": F.coalesce("avg_dep_depth", F.lit(0.0)),
        "verbs_per_sent": n("VERB", "AUX") / sents,
        **st.diversity(n("distinct"), n_words, config),
        **{name: ratio(n(*tags), n_tokens) for name, tags in st.POS_RATIOS.items()},
        "error_rate": F.lit(0.0),
    }
    if config.formality:
        found["formality_f"] = ratio(n(*ann.FORMAL) - n(*ann.INFORMAL), n_tokens) * 100.0
    if config.extra_signals:
        found |= {name: F.col(f"_t_{name}") for name in st.text_signals(F.lit(1))}
        for name in ("sig_excl_per_sent", "sig_q_per_sent", "sig_ellipsis_per_sent"):
            found[name] = found[name] / sents
        found |= {
            "sig_avg_word_len": ratio(F.coalesce("word_chars", F.lit(0)), n_words),
            "sig_long_word_ratio": ratio(n("long"), n_words),
            "sig_stopword_ratio": ratio(n("stop"), n_words),
            "sig_intensifier_ratio": ratio(n("intensifier"), n_words),
            "sig_se_per_sent": n("se") / sents,
            "sig_hedge_ratio": ratio(n("hedge"), n_words),
            "sig_proper_like_ratio": ratio(n("PROPN"), n_tokens),
        }
    return joined.select(id_col, *[found[name].alias(name) for name in config.names])
