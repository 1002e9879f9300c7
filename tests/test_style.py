"""Style and emotion features against the definitions written out in Python."""

import math
import re
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from rotativa.functions import emotion as em
from rotativa.functions import lexicons
from rotativa.functions import style as st
from rotativa.functions.emotion import SignalConfig
from rotativa.functions.style import CORE_NAMES, SIGNAL_NAMES, StyleConfig
from rotativa.operators import annotations as ann
from rotativa.operators import emotion as emo
from rotativa.operators import lexicon as lx
from rotativa.operators import style as sty


def share(n, d):
    return n / max(d, 1)


def expected_style(raw):
    t = (raw or "").strip()
    words = [w.lower() for w in re.findall(r"\w+", t)]
    lengths = [len(re.findall(r"\w+", s)) for s in re.split("[.!?]+", t) if s.strip()]
    n, v, s = len(words), len(set(words)), max(len(lengths), 1)

    def among(listed):
        return sum(w in listed for w in words)

    return {
        "len_sent": n / s,
        "sconj_per_sent": among(lexicons.SUBORDINATORS) / s,
        "ttr": share(v, n),
        "redundancy": 1 - share(v, n),
        "herdans_c": math.log(max(v, 1)) / max(math.log(max(n, 1)), 1e-8),
        "root_ttr": v / math.sqrt(max(n, 1)),
        "sig_punct_ratio": share(sum(not c.isalnum() and not c.isspace() for c in t), len(t)),
        "sig_excl_per_sent": t.count("!") / s,
        "sig_q_per_sent": t.count("?") / s,
        "sig_ellipsis_per_sent": len(re.findall(r"\.{3,}", t)) / s,
        "sig_quotes_ratio": share(sum(c in "\"“”'" for c in t), len(t)),
        "sig_uppercase_ratio": share(sum(c.isupper() for c in t), sum(c.isalpha() for c in t)),
        "sig_repeated_char_ratio": share(len(re.findall(r"(.)\1\1+", t)), len(t)),
        "sig_avg_word_len": share(sum(map(len, words)), n),
        "sig_long_word_ratio": share(sum(len(w) >= 8 for w in words), n),
        "sig_stopword_ratio": share(among(lexicons.STOPWORDS), n),
        "sig_digit_ratio": share(sum(c.isdigit() for c in t), len(t)),
        "sig_percent_ratio": share(t.count("%"), len(t)),
        "sig_intensifier_ratio": share(among(lexicons.INTENSIFIERS), n),
        "sig_se_per_sent": words.count("se") / s,
        "sig_hedge_ratio": share(among(lexicons.HEDGES), n),
        "sig_burstiness": pstdev(lengths) if lengths else 0.0,
    }


def test_style_without_tokens(spark, texts, documents):
    found = sty.style_features(texts.unionByName(documents.withColumn("Id", F.col("Id") + 1000)))
    assert found.columns == ["Id", *CORE_NAMES, *SIGNAL_NAMES]
    by_id = {r.Id: r for r in found.collect()}
    for row in texts.unionByName(documents.withColumn("Id", F.col("Id") + 1000)).collect():
        for name, value in expected_style(row.Text).items():
            assert by_id[row.Id][name] == pytest.approx(value, abs=1e-12), (name, row.Text)
    assert all(r.formality_f == r.avg_dep_depth == r.pos_noun_ratio == r.error_rate == 0 for r in by_id.values())
    assert all(r.ttr + r.redundancy == pytest.approx(1) for r in by_id.values())


def test_partitioning_does_not_matter(texts):
    runs = [sorted(sty.style_features(texts.repartition(n)).collect()) for n in (1, 4, 17)]
    assert runs[0] == runs[1] == runs[2]


def test_readability(spark):
    df = spark.createDataFrame([(1, "La casa verde. Hoy llueve."), (2, "")], "Id long, Text string")
    rows = {r.Id: r.ifsz for r in sty.style_features(df).collect()}
    # ca-sa ver-de la | hoy llue-ve: 5 + 3 vowel groups, 5 words, 2 sentences
    assert rows[1] == pytest.approx(206.835 - 62.3 * 8 / 5 - 5 / 2)
    assert rows[2] == pytest.approx(206.835 - 62.3 - 1)
    off = sty.style_features(df, config=StyleConfig(readability=False, extra_signals=False))
    assert off.columns == ["Id", *CORE_NAMES]
    assert {r.ifsz for r in off.collect()} == {0.0}


def tokens_of(spark, sentences, id_=1):
    """One tuple per token: text, tag, head; None as text makes a space."""
    rows = [
        (id_, s, i, text or " ", tag, head, text is None, bool(text) and text.isalpha())
        for s, sentence in enumerate(sentences) for i, (text, tag, head) in enumerate(sentence)
    ]
    return spark.createDataFrame(
        rows, "Id long, sent_id int, tok_id int, text string, upos string, head_id int, is_space boolean, is_alpha boolean")


def test_style_with_tokens(spark):
    sentences = [
        [("Ana", "PROPN", 1), ("dice", "VERB", 1), ("que", "SCONJ", 4), (None, None, 1), ("viene", "VERB", 1), (".", "PUNCT", 1)],
        [("Se", "PRON", 1), ("fue", "AUX", 1), ("ana", None, 1)],
    ]
    df = spark.createDataFrame([(1, "Ana dice que viene. Se fue ana"), (2, "sin tokens")], "Id long, Text string")
    rows = {r.Id: r for r in sty.style_features(df, tokens=tokens_of(spark, sentences)).collect()}
    r = rows[1]
    assert r.len_sent == 8 / 2
    assert r.sconj_per_sent == 1 / 2
    assert r.verbs_per_sent == 3 / 2
    assert r.ttr == 6 / 7
    assert r.formality_f == pytest.approx((1 - (1 + 3)) / 8 * 100)
    assert r.pos_noun_ratio == r.sig_proper_like_ratio == 1 / 8
    assert r.pos_verb_ratio == 3 / 8
    assert r.avg_dep_depth == pytest.approx((1 + 0 + 2 + 1 + 1 + 1 + 0 + 1) / 8)
    assert r.sig_se_per_sent == 1 / 2
    assert rows[2].len_sent == 0 and rows[2].redundancy == 1
    assert ann.pos_counts(tokens_of(spark, sentences)).filter("upos = 'X'").first().n == 1


def test_distinct_words_of_long_texts(spark):
    """Words count once in a text, wherever they stand; no row of the plan collects the words of a sentence or a text."""
    def sentence(words):
        return [(w, "X", 0) for w in words]

    df = tokens_of(spark, [sentence(["A", "b", "a"]), sentence([f"w{'x' * (i % 50)}" for i in range(200)]), sentence(["B", "c", "."])])
    df = df.unionByName(tokens_of(spark, [sentence(["a", "A"])], None)).unionByName(tokens_of(spark, [sentence([".", "!"])], 3))
    for array_tokens in (10_000, 5):
        stats = ann.token_stats(df, array_tokens=array_tokens)
        assert {r.Id: r.n_distinct for r in stats.collect()} == {1: 53, None: 1, 3: 0}
        plan = stats._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "flatten" not in plan


def walked_depth(heads, i):
    d = 0
    while heads[i] != i and d < 200:
        i, d = heads[i], d + 1
    return d


@pytest.mark.parametrize("array_tokens", [10_000, 3])
def test_dep_depth(spark, array_tokens):
    """Chains beyond the cap, a star, a tree; by arrays and by joins."""
    trees = {1: [max(i - 1, 0) for i in range(320)], 2: [0] * 50, 3: [i // 2 for i in range(70)], 4: [0], 5: [1, 1, 1]}
    all_tokens = None
    for id_, heads in trees.items():
        one = tokens_of(spark, [[("w", "X", h) for h in heads]], id_)
        all_tokens = one if all_tokens is None else all_tokens.unionByName(one)
    rows = ann.dep_depth(all_tokens, array_tokens=array_tokens).collect()
    found = {(r.Id, r.tok_id): r.depth for r in rows}
    assert len(rows) == sum(map(len, trees.values()))
    assert found == {(k, i): walked_depth(h, i) for k, h in trees.items() for i in range(len(h))}
    assert max(found.values()) == 200


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_rare_words(spark, broadcast_rows):
    df = spark.createDataFrame([(1, "uno Dos dos tres3 _ 7"), (2, ""), (3, None), (4, "dos")], "Id long, Text string")
    lexicon = spark.createDataFrame([("uno", 1.4), ("dos", 1.5)], "word string, zipf double")
    rows = {r.Id: (r.n_words, r.n_rare) for r in
            lx.oov_rate(df, "Text", lexicon, broadcast_rows=broadcast_rows).collect()}
    assert rows == {1: (6, 1), 2: (0, 0), 3: (0, 0), 4: (1, 0)}
    style = {r.Id: r.error_rate for r in sty.style_features(df, lexicon=lexicon).collect()}
    assert style == {1: pytest.approx(1 / 6), 2: 0, 3: 0, 4: 0}


def test_zipf(spark):
    df = spark.createDataFrame([(1, "a A b"), (2, "a")], "Id long, Text string")
    rows = {r.word: (r.n, r.zipf) for r in lx.zipf_lexicon(df, "Text").collect()}
    assert rows["a"] == (3, pytest.approx(math.log10(3 / 4 * 1e9)))
    assert rows["b"] == (1, pytest.approx(math.log10(1 / 4 * 1e9)))


def expected_signals(raw, per):
    t = raw or ""
    tokens = re.findall(r"\w+", t.lower())
    d = len(t) if per == "chars" else len(tokens)
    return {
        "sig_exclam_ratio": share(t.count("!"), d), "sig_question_ratio": share(t.count("?"), d),
        "sig_uppercase_ratio": share(sum(c.isupper() for c in t), sum(c.isalpha() for c in t)),
        "sig_intensifier_ratio": share(sum(w in lexicons.INTENSIFIERS for w in tokens), len(tokens)),
        "sig_len_chars": float(max(len(t), 1)), "sig_len_tokens": float(max(len(tokens), 1)),
        "sig_repeat_exclam_ratio": share(len(re.findall("!{2,}", t)), d),
        "sig_repeat_question_ratio": share(len(re.findall(r"\?{2,}", t)), d),
        "sig_elipsis_ratio": share(len(re.findall(r"\.{3,}", t)), d),
        "sig_digit_ratio": share(sum(c.isdigit() for c in t), len(t)),
        "sig_quote_ratio": share(sum(c in "\"“”'" for c in t), len(t)),
    }


@pytest.mark.parametrize("per", ["chars", "tokens"])
def test_emotion_signals(texts, per):
    rows = {r.Id: r for r in emo.emotion_signals(texts, "Text", SignalConfig(per=per)).collect()}
    for source in texts.collect():
        for name, value in expected_signals(source.Text, per).items():
            assert rows[source.Id][name] == pytest.approx(value, abs=1e-12), (name, source.Text)


def test_emoji_ratio(spark):
    df = spark.createDataFrame([(1, "👍🏽 bien 😀"), (2, "nada")], "Id long, Text string")
    rows = {r.Id: r.sig_emoji_ratio for r in emo.emotion_signals(df, "Text").collect()}
    assert rows == {1: 1.0, 2: 0.0}


def test_bad_settings():
    with pytest.raises(ValueError):
        SignalConfig(per="words")


def test_lexicon_scores(spark):
    df = spark.createDataFrame([(1, "Alegre ALEGRE triste"), (2, "nada"), (3, None)], "Id long, Text string")
    lexicon = spark.createDataFrame(
        [("alegre", "joy", 1.0), ("triste", "sad", 1.0), ("triste", "joy", 1.0)], "word string, class string, weight double")
    for rows in (100, 0):
        found = {r.Id: r.probas for r in
                 emo.lexicon_scores(df, "Text", lexicon, ["sad", "joy"], broadcast_rows=rows).collect()}
        assert found[1] == {"joy": pytest.approx(3 / 4), "sad": pytest.approx(1 / 4)}
        assert found[2] == found[3] == {"joy": 0.5, "sad": 0.5}


def test_probabilities(spark):
    df = spark.createDataFrame([(2, {"b": 0.5, "z": 0.5}), (1, {"b": 0.25, "a": 0.75})], "Id long, probas map<string,double>")
    assert emo.proba_labels(df).first().labels == ["a", "b"]
    assert emo.proba_labels(df, union=True).first().labels == ["a", "b", "z"]
    rows = {r.Id: r.v for r in df.select("Id", emo.proba_vector(F.col("probas"), ["a", "b"]).alias("v")).collect()}
    assert rows == {1: [0.75, 0.25], 2: [0.0, 0.5]}


def test_frequent_words_of_a_big_lexicon_are_not_shuffled(spark, monkeypatch):
    """Only words of letters that are none of the most frequent meet the lexicon by a shuffle; the rates are the same."""
    lexicon = spark.createDataFrame([("the", 9.0), ("of", 8.0), ("house", 5.0), ("tree", 4.0), ("odd", 1.0)], "word string, zipf double")
    df = spark.createDataFrame([(1, "the of the house, 12 odd zz"), (1, "the tree"), (2, None), (3, "the of"), (3, "the of"), (None, "zz 7")], "Id long, text string")
    small = sorted(map(str, lx.oov_rate(df, "text", lexicon, 3.0).collect()))
    shuffled, salted = [], lx.salted_join

    def seen(left, *rest):
        shuffled.append(left.count())
        return salted(left, *rest)

    monkeypatch.setattr(lx, "salted_join", seen)
    monkeypatch.setattr(lx, "HOT_WORDS", 2)
    assert sorted(map(str, lx.oov_rate(df, "text", lexicon, 3.0, broadcast_rows=0).collect())) == small
    assert shuffled == [5] and len(small) == 6  # house, odd, zz; tree; zz


def test_sentences_are_put_together_before_the_shuffle(spark):
    """Spark's lists get a row for each sentence of a batch, not each token, which they would sort and spill beyond 128 sentences."""
    heads = [max(i - 1, 0) for i in range(12)]
    sentences = [[("w", "X", h) for h in heads]] * 300
    tokens = tokens_of(spark, sentences).unionByName(tokens_of(spark, sentences[:2], None))
    for found in (ann.dep_depth(tokens), ann.token_stats(tokens)):
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        partial = [i for i, line in enumerate(lines) if "partial_collect_list" in line]
        assert partial and all("MapInArrow" in lines[i + 1] for i in partial)
    batches = [b for b in tokens.filter("Id = 1").coalesce(1).selectExpr("Id", "sent_id", "tok_id AS _t", "false AS _far").toArrow().to_batches()]
    gathered = list(ann._gather(iter(batches)))
    assert sum(b.num_rows for b in gathered) < 320 and sum(len(b.column("_s").flatten()) for b in gathered) == 3600
    stats = {r.Id: (r.n_sents, r.n_tokens, r.avg_dep_depth) for r in ann.token_stats(tokens).collect()}
    assert stats == {1: (300, 3600, 5.5), None: (2, 24, 5.5)}


def test_words_are_counted_once(spark):
    """A filter on the words of a lexicon doesn't have them counted again for the total."""
    df = spark.createDataFrame([(1, "uno Dos dos tres3"), (2, None)], "Id long, Text string")
    filtered = lx.zipf_lexicon(df, "Text").filter(F.length("word") > 3)
    assert "explode" not in filtered._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.word, r.n, r.zipf) for r in filtered.collect()] == [("tres3", 1, pytest.approx(8.39794))]


def test_style_takes_over_what_signals_counted(spark, texts):
    """Signals and style of the same text search it for words once, with the values of two searches."""
    df = texts.withColumn("copy", F.col("Text"))
    columns = st.core_features() | st.signal_features()
    both = {}
    for name in ("Text", "copy"):
        counted = st.with_style_counts(em.with_signal_counts(df, name), "Text", signals=name == "Text")
        found = counted.select("Id", *[c.alias(n) for n, c in (columns | {f"e_{n}": c for n, c in em.signal_features().items()}).items()])
        both[name] = {r.Id: r for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"_(?:em|st)_skeleton#\d+", plan)) and plan.count("N}_]+, w,") == (1 if name == "Text" else 2)
    assert both["Text"] == both["copy"]
