"""Column functions against plain Python, on hard texts and on all documents."""

import re

import pytest
from pyspark.sql import functions as F

from rotativa.functions import chars, text, tokens

SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]


def expected_clean(t):
    t = re.sub("[\x00-\x1f\x7f-\x9f​‌‍﻿]", " ", t or "")
    t = re.sub(r"(https?://\S+|www\.\S+)", "<URL>", t, flags=re.I)
    t = re.sub(r"\b[\w\.-]+@[\w\.-]+\.\w+\b", "<EMAIL>", t)
    return re.sub(r"\s+", " ", t).strip()


CASES = {
    "clean": (text.clean_text, expected_clean),
    "normalize": (text.normalize_text, lambda t: (t or "").strip()),
    "words": (lambda c: tokens.words(text.text_or_empty(c)), lambda t: re.findall(r"\w+", t or "")),
    "lower_words": (lambda c: tokens.lower_words(text.text_or_empty(c)),
                    lambda t: [w.lower() for w in re.findall(r"\w+", t or "")]),
    "signal_words": (lambda c: tokens.signal_words(text.text_or_empty(c)), lambda t: re.findall(r"\w+", (t or "").lower())),
    "symbols": (lambda c: tokens.symbols(text.text_or_empty(c)), lambda t: re.findall(r"\w+|\S", t or "")),
    "chunks": (lambda c: tokens.chunk_count(text.text_or_empty(c)), lambda t: len((t or "").split())),
    "sentences": (lambda c: tokens.sentences(text.text_or_empty(c)),
                  lambda t: [s.strip() for s in re.split("[.!?]+", t or "") if s.strip()]),
    "lengths": (lambda c: tokens.sentence_lengths(text.text_or_empty(c)),
                lambda t: [len(re.findall(r"\w+", s)) for s in re.split("[.!?]+", t or "") if s.strip()]),
}


@pytest.mark.parametrize("name", CASES)
def test_like_python(spark, texts, documents, name):
    function, expected = CASES[name]
    rows = texts.unionByName(documents).select("Text", function(F.col("Text")).alias("out")).collect()
    wrong = [(r.Text, r.out, expected(r.Text)) for r in rows if r.out != expected(r.Text)]
    # A combining dot is part of no word; Python's \w agrees, so nothing is left out here.
    assert not wrong[:3]


def test_space_classes_agree_with_python(spark):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p != 0xFEFF]
    df = spark.createDataFrame([(chr(p),) for p in points], "c string")
    found = df.filter(F.col("c").rlike(rf"\A{chars.SPACE_CHAR}\z")).collect()
    assert sorted(r.c for r in found) == sorted(SPACES)
    not_found = df.filter(F.col("c").rlike(rf"\A{chars.NON_SPACE_CHAR}\z")).count()
    assert not_found == len(points) - len(SPACES)
    assert sorted(chars.SPACE_CHARS) == sorted(SPACES)


def test_character_counts_agree_with_python(spark, texts, documents):
    t = F.col("Text")
    sk = chars.word_skeleton(t)
    dense, numbers = chars.drop_spaces(sk), chars.numbers_only(t)
    rows = texts.filter(t.isNotNull()).unionByName(documents).select(
        "Text", chars.count_letters(t, sk, numbers).alias("letters"), chars.count_upper(t).alias("upper"),
        chars.count_digits(numbers).alias("digits"), chars.count_punctuation(t, dense).alias("punct"),
        chars.count_quotes(dense).alias("quotes"), chars.count_char(dense, "!").alias("excl"),
    ).collect()
    for r in rows:
        x = r.Text
        assert r.letters == sum(c.isalpha() for c in x), x
        assert r.upper == sum(c.isupper() for c in x), x
        assert r.digits == sum(c.isdigit() for c in x), x
        assert r.punct == sum(not c.isalnum() and not c.isspace() for c in x), x
        assert r.quotes == sum(c in "\"“”'" for c in x), x
        assert r.excl == x.count("!"), x


def test_emoji_one_code_point_each(spark):
    given = {"😀": 1, "👍🏽": 2, "🇪🇸": 0, "©": 1, "ℹ a": 1, "a1#*": 0, "❤️": 1, "👨‍👩‍👧": 3, "": 0}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    t = F.col("t")
    rows = df.select("t", chars.count_emoji(t, chars.drop_spaces(chars.word_skeleton(t))).alias("n")).collect()
    assert {r.t: r.n for r in rows} == given


def test_masks_can_be_switched_off(spark):
    df = spark.createDataFrame([("a http://b.c d@e.fg",)], "t string")
    both = df.select(text.clean_text(F.col("t"), urls=False, emails=False)).first()[0]
    assert both == "a http://b.c d@e.fg"
    assert df.select(text.clean_text(F.col("t"), urls=False)).first()[0] == "a http://b.c <EMAIL>"
    assert df.select(text.clean_text(F.col("t"), emails=False)).first()[0] == "a <URL> d@e.fg"


def test_headline_and_body(spark):
    rows = [(None, None), ("H", None), (None, "B "), (" H", "B")]
    df = spark.createDataFrame(rows, "h string, b string")
    out = [r[0] for r in df.select(text.join_headline_body(F.col("h"), F.col("b"))).collect()]
    assert out == ["", "H", "B", "H\n\nB"]
