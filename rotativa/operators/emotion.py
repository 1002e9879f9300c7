"""Emotion block: style signals, class probabilities from a lexicon or a model, and their vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emotion as em
from ..functions import tokens
from ..functions.emotion import SignalConfig
from ..functions.numeric import safe
from ..functions.text import text_or_empty
from ..session import stored
from .corpus import ID, LABEL, require_columns, with_label
from .lexicon import text_key
from .skew import BROADCAST_ROWS, is_small, salted_join

NAMES_KEY = "names"


def emotion_signals(
    df: DataFrame, text: str = "text_xlmr", config: SignalConfig = SignalConfig(), keep: Sequence[str] = (ID,)
) -> DataFrame:
    """Kept columns and one column per signal. Row-local."""
    require_columns(df, [*keep, text])
    counted = em.with_signal_counts(df, text)
    return counted.select(*keep, *[c.alias(name) for name, c in em.signal_features(config).items()])


def scored_words(
    df: DataFrame, text: str, lexicons: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``keys`` and, per lexicon, a map of class to probability, all in one pass over the words.

    The lexicons ``word, class, weight`` become one row per word with all weights, stored, so that each runs once.
    Beside a broadcast table the sums shrink to one row per text before the shuffle; beside a bigger one words are
    counted per text before they are joined.
    """
    listed, names = None, {}
    for i, (out, (lexicon, classes)) in enumerate(lexicons.items()):
        names[out] = {name: f"_w{i}_{j}" for j, name in enumerate(sorted(classes))}
        column = F.concat(F.lit(f"{i}:"), "class").alias("class")
        part = lexicon.filter(F.col("class").isin(*classes)).select(F.col("word").alias("_word"), column, "weight")
        listed = part if listed is None else listed.union(part)
    pivoted = {f"{i}:{name}": c for i, out in enumerate(lexicons) for name, c in names[out].items()}
    wide = listed.groupBy("_word").pivot("class", list(pivoted)).agg(F.sum("weight"))
    weights = stored(wide.select("_word", *[F.col(f"`{k}`").alias(c) for k, c in pivoted.items()]), "weights")
    words = df.select(
        *keys, F.explode_outer(tokens.signal_words(text_or_empty(F.col(text)))).alias("_word"), F.lit(1).alias("_n")
    )
    if is_small(weights, broadcast_rows):
        scored = words.join(F.broadcast(weights), "_word", "left")
    else:
        counted = words.groupBy(*keys, "_word").agg(F.sum("_n").alias("_n"))
        scored = salted_join(counted, weights, ["_word"], "left", list(keys))
    sums = [F.coalesce(F.sum(F.col("_n") * F.col(c)), F.lit(0.0)).alias(c) for c in pivoted.values()]
    return scored.groupBy(*keys).agg(*sums).select(*keys, *[shares(of).alias(out) for out, of in names.items()])


def shares(columns: dict[str, str]) -> Column:
    """A map of class to its share of the sums; equal shares if all are 0."""
    total = sum((F.col(c) for c in list(columns.values())[1:]), F.col(next(iter(columns.values()))))
    pairs = [x for name, c in columns.items() for x in (
        F.lit(name), F.when(total > 0, F.col(c) / total).otherwise(1.0 / len(columns))
    )]
    return F.create_map(*pairs)


def lexicon_scores(
    df: DataFrame, text: str, lexicon: DataFrame, classes: Sequence[str], id_col: str = ID, out: str = "probas",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id`` and a map of class to probability: weights of the words found, normalised; uniform if none is found.

    One row for every row of ``df``; repeated and null ids keep their own scores.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return scored_words(rows, text, {out: (lexicon, classes)}, [id_col, "_row"], broadcast_rows).drop("_row")


def proba_labels(df: DataFrame, probas: str = "probas", id_col: str = ID, union: bool = False) -> DataFrame:
    """One row: the sorted classes of the first row by id, or of all rows."""
    if union:
        names = df.select(F.explode(F.map_keys(probas)).alias("name")).distinct()
        return names.agg(F.array_sort(F.collect_list("name")).alias("labels"))
    first = df.agg(F.min_by(F.map_keys(probas), F.col(id_col)).alias("keys"))
    return first.select(F.array_sort("keys").alias("labels"))


def proba_vector(probas: Column, labels: Sequence[str]) -> Column:
    """Probabilities in label order; an absent class is 0, classes that are no label fall away."""
    return F.array(*[
        safe(F.coalesce(F.try_element_at(probas, F.lit(name)), F.lit(0.0))) for name in labels
    ])


def named(c: Column, name: str, names: Sequence[str]) -> Column:
    """A vector column that carries its feature names in the schema instead of repeating them in every row."""
    return c.alias(name, metadata={NAMES_KEY: list(names)})


def names_of(df: DataFrame, column: str) -> list[str] | None:
    return df.schema[column].metadata.get(NAMES_KEY)


def emotion_features(
    df: DataFrame, text: str, emotions: DataFrame, sentiments: DataFrame, emo_labels: Sequence[str],
    sent_labels: Sequence[str], config: SignalConfig = SignalConfig(), id_col: str = ID,
) -> DataFrame:
    """``id, label, emo_probs, sent_probs, signals`` and the setting used; ``emotions`` and ``sentiments`` hold
    ``id, probas`` with one row per id.
    """
    keep = [id_col, LABEL] if LABEL in with_label(df).columns else [id_col]
    signals = emotion_signals(with_label(df), text, config, keep)
    rows = signals.select(*keep, F.array(*[safe(F.col(n)) for n in config.names]).alias("_signals"))
    return _vectors(
        rows.join(emotions.select(id_col, F.col("probas").alias("_emo")), id_col, "left")
        .join(sentiments.select(id_col, F.col("probas").alias("_sent")), id_col, "left"),
        keep, emo_labels, sent_labels, config,
    )


def lexicon_features(
    df: DataFrame, text: str, emotions: DataFrame, sentiments: DataFrame, emo_labels: Sequence[str],
    sent_labels: Sequence[str], config: SignalConfig = SignalConfig(), id_col: str = ID,
) -> DataFrame:
    """The same from two lexicons: one pass over the words for both, one join by id and text for any ids."""
    labelled = with_label(df).withColumn("_text", text_key(text))
    keep = [id_col, LABEL] if LABEL in labelled.columns else [id_col]
    signals = emotion_signals(labelled, text, config, [*keep, "_text"])
    rows = signals.select(*keep, "_text", F.array(*[safe(F.col(n)) for n in config.names]).alias("_signals"))
    scored = scored_words(labelled, text, {"_emo": (emotions, emo_labels), "_sent": (sentiments, sent_labels)}, [id_col, "_text"])
    found = scored.withColumnsRenamed({id_col: "_id", "_text": "_key"})
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    return _vectors(joined, keep, emo_labels, sent_labels, config)


def _vectors(
    joined: DataFrame, keep: Sequence[str], emo_labels: Sequence[str], sent_labels: Sequence[str], config: SignalConfig
) -> DataFrame:
    return joined.select(
        *keep,
        named(proba_vector(F.col("_emo"), emo_labels), "emo_probs", emo_labels),
        named(proba_vector(F.col("_sent"), sent_labels), "sent_probs", sent_labels),
        named(F.col("_signals"), "signals", config.names),
        F.lit(config.per).alias("normalize_signals_by"),
    )
