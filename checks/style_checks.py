"""Style features with and without token annotations, word frequencies, dependency depth."""

from pyspark.sql import functions as F

from rotativa.functions import lexicons, tokens
from rotativa.functions.style import CORE_NAMES, SIGNAL_NAMES, StyleConfig
from rotativa.operators import annotations as ann
from rotativa.operators import lexicon as lx
from rotativa.operators import style as sty

from .common import (
    PLAIN, QUOTES, S_DIGITS, S_PUNCT_CLASS, TAILED, W, documents, q, register, rounded, s_count, s_hits, s_inside,
    s_lower_words, s_ratio, s_round, s_runs, s_sentences, s_strip, s_words, stored, tailed,
)

CORE_ONLY = StyleConfig(extra_signals=False)
NO_OPTION = StyleConfig(readability=False, formality=False, rare_words=False, diversity=False, extra_signals=False)

# The lookahead only speeds up matching; RE2 knows none.
SYLLABLE_SQL = "(?:[aeoáéó][iuü]*|[iuü]+(?:[aeoáéó][iuü]*)?|[íú])"
FORMAL_TAGS, INFORMAL_TAGS = ("NOUN", "PROPN", "ADJ", "ADP", "DET"), ("PRON", "VERB", "AUX", "ADV", "INTJ")

# Rounded because logarithms and deviations may differ in the last bit; plain ratios are equal as they are.
LOOSE = ("ifsz", "herdans_c", "root_ttr", "sig_burstiness", "avg_dep_depth", "formality_f")


def loosely(name: str, sql: str) -> str:
    return s_round(sql) if name in LOOSE else sql


def exact(df):
    return rounded(df, *[c for c in df.columns if c in LOOSE])


# Runs of three or more equal characters, line feeds aside.
REPEATS = """(SELECT Id, count(*) AS n FROM (
  SELECT Id, c, i, lag(c, 1) OVER w AS before, lead(c, 1) OVER w AS after, lead(c, 2) OVER w AS next FROM (
    SELECT Id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM base)
  WINDOW w AS (PARTITION BY Id ORDER BY i))
  WHERE c = after AND c = next AND (before IS NULL OR before <> c) AND c <> chr(10) GROUP BY Id)"""


def counts_sql(source: str) -> str:
    return f"""base AS (SELECT Id, {s_strip('Text')} AS t FROM {source} s),
  counted AS (SELECT b.Id, t, {s_lower_words('t')} AS ws, {s_sentences('t')} AS sents, coalesce(r.n, 0) AS repeats
    FROM base b LEFT JOIN {REPEATS} r ON r.Id = b.Id),
  facts AS (SELECT *, len(ws) AS n, len(list_distinct(ws)) AS v, greatest(len(sents), 1) AS s,
    list_transform(sents, lambda x: len(regexp_extract_all(x, {W}))) AS lens FROM counted)"""


IFSZ = (
    f"206.835 - 62.3 * (CAST(greatest({s_runs('lower(t)', SYLLABLE_SQL)}, 1) AS DOUBLE) / greatest(n, 1))"
    " - CAST(greatest(n, 1) AS DOUBLE) / s"
)
DIVERSITY = {
    "ttr": s_ratio("v", "n"),
    "redundancy": f"1.0 - {s_ratio('v', 'n')}",
    "herdans_c": "ln(greatest(v, 1)) / greatest(ln(greatest(n, 1)), 1e-8)",
    "root_ttr": "v / sqrt(greatest(n, 1))",
}
CORE_SQL = {
    "ifsz": IFSZ,
    "len_sent": "CAST(n AS DOUBLE) / s",
    "sconj_per_sent": f"CAST({s_hits('ws', lexicons.SUBORDINATORS)} AS DOUBLE) / s",
    **DIVERSITY,
}
TEXT_SIGNALS_SQL = {
    "sig_punct_ratio": s_ratio(f"length(regexp_replace(t, {q(f'[{S_PUNCT_CLASS}]+')}, '', 'g'))", "length(t)"),
    "sig_excl_per_sent": f"CAST({s_count('t', '!')} AS DOUBLE) / s",
    "sig_q_per_sent": f"CAST({s_count('t', '?')} AS DOUBLE) / s",
    "sig_ellipsis_per_sent": "CAST(" + s_runs("t", r"\.{3,}") + " AS DOUBLE) / s",
    "sig_quotes_ratio": s_ratio(s_count("t", *QUOTES), "length(t)"),
    "sig_uppercase_ratio": s_ratio(s_inside("t", r"\p{Lu}"), s_inside("t", r"\p{L}")),
    "sig_repeated_char_ratio": s_ratio("repeats", "length(t)"),
    "sig_digit_ratio": s_ratio(s_inside("t", S_DIGITS), "length(t)"),
    "sig_percent_ratio": s_ratio(s_count("t", "%"), "length(t)"),
    "sig_burstiness": "coalesce(list_aggregate(lens, 'stddev_pop'), 0.0)",
}
SIGNALS_SQL = TEXT_SIGNALS_SQL | {
    "sig_avg_word_len": s_ratio("coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)", "n"),
    "sig_long_word_ratio": s_ratio("len(list_filter(ws, lambda w: length(w) >= 8))", "n"),
    "sig_stopword_ratio": s_ratio(s_hits("ws", lexicons.STOPWORDS), "n"),
    "sig_intensifier_ratio": s_ratio(s_hits("ws", lexicons.INTENSIFIERS), "n"),
    "sig_se_per_sent": f"CAST({s_hits('ws', ['se'])} AS DOUBLE) / s",
    "sig_hedge_ratio": s_ratio(s_hits("ws", lexicons.HEDGES), "n"),
    "sig_proper_like_ratio": "CAST(0 AS DOUBLE)",
}
ZERO = "CAST(0 AS DOUBLE)"


def style_sql(source: str, names, columns, head: str = "WITH ") -> str:
    listed = ", ".join(f"{loosely(n, columns.get(n, ZERO))} AS {n}" for n in names)
    return f"{head}{counts_sql(source)} SELECT Id, {listed} FROM facts"


@register("style_core", style_sql(PLAIN, CORE_NAMES, CORE_SQL))
def style_core(spark, sf):
    return exact(sty.style_features(documents(spark, sf), "text", CORE_ONLY))


@register("style_signals", style_sql(TAILED, SIGNAL_NAMES, SIGNALS_SQL))
def style_signals(spark, sf):
    return exact(sty.style_features(tailed(spark, sf))).select("Id", *SIGNAL_NAMES)


@register("style_features", style_sql(TAILED, CORE_NAMES + SIGNAL_NAMES, CORE_SQL | SIGNALS_SQL))
def style_features(spark, sf):
    return exact(sty.style_features(tailed(spark, sf)))


@register("style_features_off", style_sql(
    PLAIN, CORE_NAMES, {k: v for k, v in CORE_SQL.items() if k not in ("ifsz", "herdans_c", "root_ttr")}))
def style_features_off(spark, sf):
    return exact(sty.style_features(documents(spark, sf), "text", NO_OPTION))


# Own word lists: every word of the tail counts as a stopword, "de" as an intensifier.
OWN = StyleConfig(stopwords=("el", "the", "der", "le"), intensifiers=("de", "of"))


@register("style_own_lists", style_sql(PLAIN, ("sig_stopword_ratio", "sig_intensifier_ratio"), {
    "sig_stopword_ratio": s_ratio(s_hits("ws", OWN.stopwords), "n"),
    "sig_intensifier_ratio": s_ratio(s_hits("ws", OWN.intensifiers), "n"),
}))
def style_own_lists(spark, sf):
    found = sty.style_features(documents(spark, sf), "text", OWN)
    return found.select("Id", "sig_stopword_ratio", "sig_intensifier_ratio")


def one_feature(name):
    @register(name, style_sql(PLAIN, (name,), CORE_SQL))
    def run(spark, sf):
        return exact(sty.style_features(documents(spark, sf), "text", CORE_ONLY)).select("Id", name)


for feature in ("ifsz", "len_sent", "sconj_per_sent", "ttr", "redundancy", "herdans_c", "root_ttr"):
    one_feature(feature)


# --- word frequencies -------------------------------------------------------------------------------------------

def over(sql: str, source: str) -> str:
    return sql.replace("@SOURCE", source)


ZIPF_SQL = f"""lexicon AS (SELECT word, count(*) AS n,
    log10(CAST(count(*) AS DOUBLE) / (SELECT CAST(sum(len({s_words('Text')})) AS DOUBLE) FROM @SOURCE x) * 1e9) AS zipf
  FROM (SELECT unnest({s_lower_words('Text')}) AS word FROM @SOURCE y) GROUP BY word)"""


@register("zipf_lexicon", "WITH " + over(ZIPF_SQL, PLAIN) + f" SELECT word, n, {s_round('zipf')} AS zipf FROM lexicon")
def zipf_lexicon(spark, sf):
    return rounded(lx.zipf_lexicon(documents(spark, sf), "text"), "zipf")


BELOW = 4.2
TRAIN = "(SELECT doc_id AS Id, text AS Text FROM documents WHERE doc_id % 10 < 8)"


def lexicon(spark, sf):
    """Frequencies in the train split."""
    return stored(lx.zipf_lexicon(documents(spark, sf).filter("Id % 10 < 8"), "text"), "zipf")


RARE_SQL = f"""words AS (SELECT Id, unnest({s_lower_words('Text')}) AS word FROM @SOURCE d),
  rated AS (SELECT w.Id, count(*) AS n_words,
    count(*) FILTER (WHERE regexp_full_match(w.word, '\\p{{L}}+') AND coalesce(l.zipf, 0) < {BELOW}) AS n_rare
    FROM words w LEFT JOIN lexicon l ON l.word = w.word GROUP BY w.Id),
  rates AS (SELECT d.Id, coalesce(n_words, 0) AS n_words, coalesce(n_rare, 0) AS n_rare,
    CAST(coalesce(n_rare, 0) AS DOUBLE) / greatest(coalesce(n_words, 0), 1) AS error_rate
    FROM @SOURCE d LEFT JOIN rated r ON r.Id = d.Id)"""


@register("oov_rate", f"WITH {over(ZIPF_SQL, TRAIN)}, {over(RARE_SQL, PLAIN)} SELECT Id, n_words, n_rare, error_rate FROM rates")
def oov_rate(spark, sf):
    return lx.oov_rate(documents(spark, sf), "text", lexicon(spark, sf), BELOW)


@register("oov_rate_big_lexicon",
          f"WITH {over(ZIPF_SQL, TRAIN)}, {over(RARE_SQL, PLAIN)} SELECT Id, n_words, n_rare, error_rate FROM rates")
def oov_rate_big_lexicon(spark, sf):
    """The path for a lexicon that is too big to broadcast."""
    return lx.oov_rate(documents(spark, sf), "text", lexicon(spark, sf), BELOW, broadcast_rows=0)


@register("error_rate", f"WITH {over(ZIPF_SQL, TRAIN)}, {over(RARE_SQL, PLAIN)} SELECT Id, error_rate FROM rates")
def error_rate(spark, sf):
    config = StyleConfig(rare_below_zipf=BELOW)
    found = sty.style_features(documents(spark, sf), "text", config, lexicon=lexicon(spark, sf))
    return found.select("Id", "error_rate")


# --- token annotations ------------------------------------------------------------------------------------------

TAGS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "SCONJ", "INTJ", "PUNCT", "X")
SENTENCE = 120


def annotated(spark, sf, store=True):
    """Annotations derived from the words of all documents: sentences of 120 tokens, every third one chain of heads,
    the others binary trees; some tokens without tag, some marked as spaces.
    """
    words = documents(spark, sf).select("Id", F.posexplode(tokens.words(F.col("text"))).alias("pos", "text"))
    sent, tok = F.floor(F.col("pos") / SENTENCE), F.col("pos") % SENTENCE
    tag = F.get(F.array(*map(F.lit, TAGS)), (F.col("pos") % len(TAGS)).cast("int"))
    annotations = words.select(
        "Id", sent.cast("int").alias("sent_id"), tok.cast("int").alias("tok_id"), "text",
        F.when(F.col("pos") % 17 != 0, tag).alias("upos"),
        F.when(sent % 3 == 0, F.greatest(tok - 1, F.lit(0))).otherwise(F.floor(tok / 2)).cast("int").alias("head_id"),
        (F.col("pos") % 11 == 10).alias("is_space"), F.col("text").rlike(r"^\p{L}+$").alias("is_alpha"),
    )
    return stored(annotations, "tokens") if store else annotations


TOKENS_SQL = f"""tokens AS (SELECT Id, CAST(pos // {SENTENCE} AS INT) AS sent_id, CAST(pos % {SENTENCE} AS INT) AS tok_id,
  word AS text, CASE WHEN pos % 17 <> 0 THEN ({list(TAGS)})[pos % {len(TAGS)} + 1] END AS upos,
  CAST(CASE WHEN (pos // {SENTENCE}) % 3 = 0 THEN greatest(pos % {SENTENCE} - 1, 0) ELSE (pos % {SENTENCE}) // 2 END AS INT)
    AS head_id,
  pos % 11 = 10 AS is_space, regexp_full_match(word, '\\p{{L}}+') AS is_alpha
  FROM (SELECT Id, unnest({s_words('Text')}) AS word, generate_subscripts({s_words('Text')}, 1) - 1 AS pos FROM {PLAIN} d))"""

# Depth by walking up, one recursion step per head.
DEPTH_SQL = """depth(Id, sent_id, tok_id, cur, d) AS (
  SELECT Id, sent_id, tok_id, tok_id, 0 FROM tokens WHERE NOT is_space
  UNION ALL
  SELECT p.Id, p.sent_id, p.tok_id, t.head_id, p.d + 1 FROM depth p JOIN tokens t
    ON t.Id = p.Id AND t.sent_id = p.sent_id AND t.tok_id = p.cur WHERE t.head_id <> t.tok_id AND p.d < 200),
  deepest AS (SELECT Id, sent_id, tok_id, max(d) AS depth FROM depth GROUP BY ALL)"""


@register("token_table", f"""WITH {TOKENS_SQL} SELECT Id, sent_id, tok_id, text, coalesce(upos, 'X') AS upos, head_id, is_alpha
  FROM tokens WHERE NOT is_space""")
def token_table(spark, sf):
    return ann.token_table(annotated(spark, sf, store=False)).drop("is_space")


@register("pos_counts", f"""WITH {TOKENS_SQL} SELECT Id, coalesce(upos, 'X') AS upos, count(*) AS n FROM tokens
  WHERE NOT is_space GROUP BY ALL""")
def pos_counts(spark, sf):
    return ann.pos_counts(annotated(spark, sf, store=False))


@register("dep_depth", f"WITH RECURSIVE {TOKENS_SQL}, {DEPTH_SQL} SELECT Id, sent_id, tok_id, depth FROM deepest")
def dep_depth(spark, sf):
    return ann.dep_depth(annotated(spark, sf))


@register("dep_depth_long_sentences",
          f"WITH RECURSIVE {TOKENS_SQL}, {DEPTH_SQL} SELECT Id, sent_id, tok_id, depth FROM deepest")
def dep_depth_long_sentences(spark, sf):
    """Full sentences take the path for sentences that are too long for one row."""
    return ann.dep_depth(annotated(spark, sf), array_tokens=SENTENCE - 1)


def tag_sum(*tags):
    return "(" + " + ".join(f"n_{t.lower()}" for t in tags) + ")"


STATS_SQL = f"""stats AS (SELECT Id, count(*) FILTER (WHERE NOT is_space) AS nt,
  count(*) FILTER (WHERE NOT is_space AND is_alpha) AS nw,
  count(DISTINCT sent_id) AS ns, count(DISTINCT lower(text)) FILTER (WHERE NOT is_space AND is_alpha) AS nv,
  sum(length(lower(text))) FILTER (WHERE NOT is_space AND is_alpha) AS n_chars,
  count(*) FILTER (WHERE NOT is_space AND is_alpha AND length(lower(text)) >= 8) AS n_long,
  {", ".join(
    f"count(*) FILTER (WHERE NOT is_space AND is_alpha AND lower(text) IN ({', '.join(map(q, words))})) AS n_{name}"
    for name, words in dict(stop=lexicons.STOPWORDS, intens=lexicons.INTENSIFIERS, hedge=lexicons.HEDGES, se=['se']).items())},
  {", ".join(f"count(*) FILTER (WHERE NOT is_space AND upos = {q(t)}) AS n_{t.lower()}" for t in TAGS if t != "X")}
  FROM tokens GROUP BY Id),
  depths AS (SELECT Id, CAST(sum(depth) AS DOUBLE) / count(*) AS avg_depth FROM deepest GROUP BY Id)"""

TAGGED_SQL = {
    "ifsz": IFSZ,
    "formality_f": (
        f"CAST({tag_sum(*FORMAL_TAGS)} - {tag_sum(*INFORMAL_TAGS)} AS DOUBLE) / greatest(nt, 1) * 100.0"),
    "len_sent": "CAST(nt AS DOUBLE) / greatest(ns, 1)",
    "sconj_per_sent": "CAST(n_sconj AS DOUBLE) / greatest(ns, 1)",
    "avg_dep_depth": "avg_depth",
    "verbs_per_sent": f"CAST({tag_sum('VERB', 'AUX')} AS DOUBLE) / greatest(ns, 1)",
    "ttr": s_ratio("nv", "nw"),
    "redundancy": f"1.0 - {s_ratio('nv', 'nw')}",
    "herdans_c": "ln(greatest(nv, 1)) / greatest(ln(greatest(nw, 1)), 1e-8)",
    "root_ttr": "nv / sqrt(greatest(nw, 1))",
    "pos_noun_ratio": s_ratio(tag_sum("NOUN", "PROPN"), "nt"),
    "pos_verb_ratio": s_ratio(tag_sum("VERB", "AUX"), "nt"),
    **{f"pos_{t.lower()}_ratio": s_ratio(f"n_{t.lower()}", "nt") for t in ("ADJ", "ADV", "PRON", "DET", "ADP")},
    **TEXT_SIGNALS_SQL,
    "sig_excl_per_sent": f"CAST({s_count('t', '!')} AS DOUBLE) / greatest(ns, 1)",
    "sig_q_per_sent": f"CAST({s_count('t', '?')} AS DOUBLE) / greatest(ns, 1)",
    "sig_ellipsis_per_sent": "CAST(" + s_runs("t", r"\.{3,}") + " AS DOUBLE) / greatest(ns, 1)",
    "sig_avg_word_len": s_ratio("n_chars", "nw"),
    "sig_long_word_ratio": s_ratio("n_long", "nw"),
    "sig_stopword_ratio": s_ratio("n_stop", "nw"),
    "sig_intensifier_ratio": s_ratio("n_intens", "nw"),
    "sig_se_per_sent": "CAST(n_se AS DOUBLE) / greatest(ns, 1)",
    "sig_hedge_ratio": s_ratio("n_hedge", "nw"),
    "sig_proper_like_ratio": s_ratio("n_propn", "nt"),
}


def tagged_sql(names) -> str:
    listed = ", ".join(f"{loosely(n, f'coalesce({TAGGED_SQL.get(n, ZERO)}, 0)')} AS {n}" for n in names)
    return f"""WITH RECURSIVE {TOKENS_SQL}, {DEPTH_SQL}, {STATS_SQL}, {counts_sql(PLAIN)}
      SELECT f.Id, {listed} FROM facts f LEFT JOIN stats USING (Id) LEFT JOIN depths USING (Id)"""


def tagged(spark, sf, config=StyleConfig()):
    return exact(sty.style_features(documents(spark, sf), "text", config, tokens=annotated(spark, sf)))


@register("style_features_tagged", tagged_sql(CORE_NAMES + SIGNAL_NAMES))
def style_features_tagged(spark, sf):
    return tagged(spark, sf)


TAG_FEATURES = ("formality_f", "avg_dep_depth", "verbs_per_sent", "pos_noun_ratio", "pos_verb_ratio", "pos_adj_ratio",
                "pos_adv_ratio", "pos_pron_ratio", "pos_det_ratio", "pos_adp_ratio")


def one_tag_feature(name):
    @register(name, tagged_sql((name,)))
    def run(spark, sf):
        return tagged(spark, sf, CORE_ONLY).select("Id", name)


for feature in TAG_FEATURES:
    one_tag_feature(feature)


SLICE = ("len_sent", "ttr", "sig_stopword_ratio", "sig_punct_ratio", "sig_uppercase_ratio", "sig_repeated_char_ratio",
         "sig_burstiness")


@register("style_slice", style_sql(PLAIN, SLICE, CORE_SQL | SIGNALS_SQL))
def style_slice(spark, sf):
    """Seven features: words, distinct words, stopwords, sentences, punctuation, upper case, repeated characters."""
    return exact(sty.style_features(documents(spark, sf), "text").select("Id", *SLICE))
