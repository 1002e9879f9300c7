"""Emotion signals, lexicon and model scores."""

from pyspark.sql import functions as F

from rotativa.functions import lexicons
from rotativa.functions.emotion import BASE_NAMES, EXTRA_NAMES, SignalConfig
from rotativa.operators import emotion as emo
from rotativa.operators import lexicon as lx
from rotativa.operators import merge as mg
from rotativa.operators import scoring

from .common import (
    NEWS, PLAIN, QUOTES, S_DIGITS, S_EMOJI, S_PUNCT_CLASS, S_SPACE, TAILED, documents, news, q, register, rounded,
    s_count, s_hits, s_inside, s_lower_words, s_ratio, s_round, s_runs, s_words, stored, tailed, with_workers,
)

NAMES = BASE_NAMES + EXTRA_NAMES


def signals_sql(per: str) -> dict[str, str]:
    return {
        "sig_exclam_ratio": s_ratio(s_count("t", "!"), per),
        "sig_question_ratio": s_ratio(s_count("t", "?"), per),
        "sig_uppercase_ratio": s_ratio(s_inside("t", r"\p{Lu}"), s_inside("t", r"\p{L}")),
        "sig_emoji_ratio": s_ratio(s_inside("t", S_EMOJI), s_runs("t", f"[^{S_SPACE}]+")),
        "sig_intensifier_ratio": s_ratio(s_hits("ws", lexicons.INTENSIFIERS), "len(ws)"),
        "sig_len_chars": "CAST(greatest(length(t), 1) AS DOUBLE)",
        "sig_len_tokens": "CAST(greatest(len(ws), 1) AS DOUBLE)",
        "sig_punct_ratio": s_ratio(f"length(regexp_replace(t, {q(f'[{S_PUNCT_CLASS}]+')}, '', 'g'))", "length(t)"),
        "sig_digit_ratio": s_ratio(s_inside("t", S_DIGITS), "length(t)"),
        "sig_repeat_exclam_ratio": s_ratio(s_runs("t", "!{2,}"), per),
        "sig_repeat_question_ratio": s_ratio(s_runs("t", r"\?{2,}"), per),
        "sig_elipsis_ratio": s_ratio(s_runs("t", r"\.{3,}"), per),
        "sig_quote_ratio": s_ratio(s_count("t", *QUOTES), "length(t)"),
    }


def signal_query(source: str, per: str = "length(t)", names=NAMES) -> str:
    listed = ", ".join(f"{signals_sql(per)[n]} AS {n}" for n in names)
    return f"SELECT Id, {listed} FROM (SELECT Id, Text AS t, {s_words('lower(Text)')} AS ws FROM {source} s)"


@register("emotion_signals", signal_query(TAILED))
def emotion_signals(spark, sf):
    return emo.emotion_signals(tailed(spark, sf), "Text")


@register("emotion_signals_tokens", signal_query(TAILED, "len(ws)"))
def emotion_signals_tokens(spark, sf):
    return emo.emotion_signals(tailed(spark, sf), "Text", SignalConfig(per="tokens"))


@register("emotion_signals_base", signal_query(TAILED, names=BASE_NAMES))
def emotion_signals_base(spark, sf):
    return emo.emotion_signals(tailed(spark, sf), "Text", SignalConfig(extra=False))


# A lexicon made from the corpus: frequent words, class by length, weight by frequency.
CLASSES = ("anger", "fear", "joy")
TONES = ("NEG", "POS")
FREQUENT = 5.0  # log10 of occurrences per billion words: one in ten thousand


def frequent_words(spark, sf):
    counts = lx.zipf_lexicon(documents(spark, sf), "text").filter((F.col("zipf") >= FREQUENT) & (F.length("word") > 2))
    return stored(counts.select("word"), "frequent")


def lexicon(spark, sf, classes, words=None):
    counts = frequent_words(spark, sf) if words is None else words
    kind = F.get(F.array(*map(F.lit, classes)), (F.length("word") % len(classes)).cast("int"))
    return counts.select("word", kind.alias("class"), (1.0 / F.length("word")).alias("weight"))


def scores_sql(name: str, classes) -> str:
    listed = f"({list(classes)})[length(word) % {len(classes)} + 1]"
    sums = ", ".join(f"coalesce(sum(l.weight) FILTER (WHERE l.class = {q(c)}), 0) AS w_{c}" for c in classes)
    total = " + ".join(f"w_{c}" for c in classes)
    shares = ", ".join(
        f"CASE WHEN {total} > 0 THEN w_{c} / ({total}) ELSE 1.0::DOUBLE / {len(classes)} END AS {c}" for c in classes)
    return f"""{name}_lexicon AS (SELECT word, {listed} AS class, CAST(1 AS DOUBLE) / length(word) AS weight
    FROM (SELECT unnest({s_lower_words('Text')}) AS word FROM {PLAIN} d)
    GROUP BY word HAVING length(word) > 2 AND log10(CAST(count(*) AS DOUBLE)
      / (SELECT CAST(sum(len({s_words('Text')})) AS DOUBLE) FROM {PLAIN} a) * 1e9) >= {FREQUENT}),
  {name}_sums AS (SELECT d.Id, {sums} FROM {PLAIN} d
    LEFT JOIN (SELECT Id, unnest({s_words('lower(Text)')}) AS word FROM {PLAIN} x) t ON t.Id = d.Id
    LEFT JOIN {name}_lexicon l ON l.word = t.word GROUP BY d.Id),
  {name} AS (SELECT Id, {shares} FROM {name}_sums)"""


def scores(spark, sf, classes):
    return emo.lexicon_scores(documents(spark, sf), "text", lexicon(spark, sf, classes), classes)


@register("lexicon_emotion", f"""WITH {scores_sql('emo', CLASSES)}
  SELECT Id, {", ".join(f"{s_round(c)} AS {c}" for c in CLASSES)} FROM emo""")
def lexicon_emotion(spark, sf):
    found = scores(spark, sf, CLASSES)
    return rounded(found.select("Id", *[F.col("probas")[c].alias(c) for c in CLASSES]), *CLASSES)


@register("proba_labels", f"""SELECT i AS position, c AS label FROM (SELECT unnest({list(CLASSES)}) AS c,
  generate_subscripts({list(CLASSES)}, 1) - 1 AS i) WHERE EXISTS (SELECT 1 FROM documents)""")
def proba_labels(spark, sf):
    found = emo.proba_labels(scores(spark, sf, CLASSES))
    return found.select(F.posexplode("labels").alias("position", "label")).withColumn(
        "position", F.col("position").cast("long"))


# Maps whose keys differ by row: one key per event type a user has, valued by its share of the user's events.
USER_SHARES = """SELECT user_id, event_type, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS p
  FROM events GROUP BY user_id, event_type"""
VECTOR_LABELS = ("click", "error", "purchase", "unheard")


def user_shares(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type")
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # One entry per event type: the array is as short as there are types.
    per_user = counts.groupBy("user_id").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("event_type", "n")).alias("e"))
    return per_user.select(F.col("user_id").alias("Id"), F.map_from_entries(F.transform(
        "e", lambda x: F.struct(x["event_type"], (x["n"] / F.col("total"))))).alias("probas"))


@register("proba_vector", f"""SELECT u.user_id AS Id, l.i AS position, coalesce(s.p, 0.0) AS p
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest({list(VECTOR_LABELS)}) AS label, generate_subscripts({list(VECTOR_LABELS)}, 1) - 1 AS i) l
  LEFT JOIN ({USER_SHARES}) s ON s.user_id = u.user_id AND s.event_type = l.label""")
def proba_vector(spark, sf):
    vectors = user_shares(spark, sf).select("Id", emo.proba_vector(F.col("probas"), VECTOR_LABELS).alias("v"))
    return vectors.select("Id", F.posexplode("v").alias("position", "p")).withColumn(
        "position", F.col("position").cast("long"))


@register("proba_labels_union", """SELECT row_number() OVER (ORDER BY event_type) - 1 AS position, event_type AS label
  FROM (SELECT DISTINCT event_type FROM events)""")
def proba_labels_union(spark, sf):
    found = emo.proba_labels(user_shares(spark, sf), union=True)
    return found.select(F.posexplode("labels").alias("position", "label")).withColumn(
        "position", F.col("position").cast("long"))


def emotion_frame(spark, sf, text="text"):
    docs, words = news(spark, sf).withColumnRenamed("Text", text), frequent_words(spark, sf)  # counted once for both lexicons
    return emo.lexicon_features(
        docs, text, lexicon(spark, sf, CLASSES, words), lexicon(spark, sf, TONES, words), CLASSES, TONES)


EMO_LIST = [*CLASSES, *TONES]
EMOTION_SQL = f"""{scores_sql('emo', CLASSES)}, {scores_sql('sent', TONES)},
  signals AS ({signal_query(PLAIN)}),
  emotion AS (SELECT n.Id, n.Category AS label, {", ".join(EMO_LIST)}, {", ".join(NAMES)}
    FROM {NEWS} n JOIN emo USING (Id) JOIN sent USING (Id) JOIN signals USING (Id))"""


@register("emotion_features", f"""WITH {EMOTION_SQL} SELECT Id, label,
  {", ".join(f"{s_round(c)} AS {c}" for c in EMO_LIST)}, {", ".join(NAMES)}, 'chars' AS normalize_signals_by FROM emotion""")
def emotion_features(spark, sf):
    frame = emotion_frame(spark, sf)
    return rounded(frame.select(
        "Id", "label", *[F.col("emo_probs")[i].alias(c) for i, c in enumerate(CLASSES)],
        *[F.col("sent_probs")[i].alias(c) for i, c in enumerate(TONES)],
        *[F.col("signals")[i].alias(c) for i, c in enumerate(NAMES)], "normalize_signals_by",
    ), *EMO_LIST)


ALL_NAMES = [f"emo_emo_{c}" for c in CLASSES] + [f"emo_sent_{c}" for c in TONES] + [f"emo_{n}" for n in NAMES]


@register("emotion_hstack", f"""WITH {EMOTION_SQL} SELECT Id,
  {", ".join(f"{s_round(c)} AS {n}" for c, n in zip([*EMO_LIST, *NAMES], ALL_NAMES))} FROM emotion""")
def emotion_hstack(spark, sf):
    frame = emotion_frame(spark, sf)
    names = mg.emotion_names(frame)
    return rounded(mg.vector_to_columns(mg.emotion_hstack(frame), names), *names)


class CountingModel:
    """A stand-in for a classifier: the share of words with more than five letters, and the rest."""

    def predict_many(self, texts, batch_size):
        return [self._one(text) for text in texts]

    @staticmethod
    def _one(text):
        words = text.split(" ")
        long = sum(len(w) > 5 for w in words) / len(words)
        return {"long": long, "short": 1.0 - long}


@register("score_documents", """SELECT Id, n AS long_share, 1.0 - n AS short_share FROM (SELECT doc_id AS Id,
  CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 5)) AS DOUBLE) / len(string_split(text, ' ')) AS n
  FROM documents)""")
def score_documents(spark, sf):
    with_workers(spark)
    found = scoring.score_documents(documents(spark, sf), "text", CountingModel)
    return found.select("Id", F.col("probas")["long"].alias("long_share"), F.col("probas")["short"].alias("short_share"))
