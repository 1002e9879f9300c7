"""Language identification, words first: known words by their frequency in each language, unseen ones by character n-grams.

Learning: a sample of labelled rows, bounded per language by ``LangIdConfig.rows_per_language`` (a hash of the key
decides, scaled by exact counts of the labels), is counted by Spark: words per language. The driver
takes the n-grams of those words, with word edges marked. The model has the sample's bound, so it is broadcast.

Prediction: every run of letters, lower-cased, of the whole text. A known word adds its smoothed log frequency in each
language. An unseen word is cut into the longest n-grams of which any is known, and adds their mean log frequency: n
falls from 5 to 1 until one is known. The score is the probability of the best language under the sum, so texts without
evidence score 1 / languages. Ties go to the first language in the alphabet.

Null text and text without a letter (Unicode category L) are ``und`` with score 0. Rows with null text or null label
teach nothing. Without any labelled row every text is ``und``. Rows are read alone: no shuffle, no hot key.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, with_workers

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
KNOWN_WORDS = 100_000  # words a worker remembers
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class LangIdConfig:
    rows_per_language: int = 500  # expected rows of a language in the sample; all rows where it has fewer
    least_count: int = 2  # a word seen so often in the sample is known
    longest: int = 5  # n-grams from here down to 1
    smoothing: float = 0.5


def sample(labelled: DataFrame, key: str, lang: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each language: those with a small hash, by exact counts. The same rows on any rerun."""
    counts = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    bound = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(min(1.0, rows / r["n"])))])
    place = F.pmod(F.xxhash64(key, "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return labelled.where(place < bound[F.col(lang)]) if counts else labelled.limit(0)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row of a word in ``logs``
    grams: dict[str, int]
    logs: np.ndarray  # log frequency in each language
    longest: int


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", config: LangIdConfig = LangIdConfig()) -> Model:
    """Count words and n-grams per language in a bounded sample of ``labelled``."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    chosen = sample(rows, "key", "lang", config.rows_per_language)
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counts = chosen.select("lang", F.explode(letters).alias("word")).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    return fit(counts.toArrow(), config)  # bounded by the sample


class Tally:
    """Counts of strings by language: a place for each string in one flat array, so that no string has an array of its own."""

    def __init__(self, languages: int):
        self.places: dict[str, int] = {}
        self.zeros = [0.0] * languages
        self.flat = array("d")

    def add(self, key: str, language: int, n: int) -> None:
        at = self.places.setdefault(key, len(self.flat))
        if at == len(self.flat):
            self.flat.extend(self.zeros)
        self.flat[at + language] += n

    def counts(self) -> np.ndarray:
        return np.array(self.flat).reshape(-1, max(1, len(self.zeros)))


def fit(counts: pa.Table, config: LangIdConfig) -> Model:
    languages = sorted(counts["lang"].unique().to_pylist())
    place = {x: i for i, x in enumerate(languages)}
    words = Tally(len(languages))
    grams = [Tally(len(languages)) for _ in range(config.longest)]
    for batch in counts.to_batches(max_chunksize=10_000):
        for word, lang, count in zip(*(batch[name].to_pylist() for name in ("word", "lang", "n")), strict=True):
            words.add(word, place[lang], count)
            for n, tally in enumerate(grams, 1):
                for gram in cut(word, n):
                    tally.add(gram, place[lang], count)
    rows: list[np.ndarray] = []

    def logs(table: Tally, least: float = 0.0) -> dict[str, int]:
        cells = table.counts()
        kept = cells.sum(axis=1) >= least
        first, places = sum(map(len, rows)), np.cumsum(kept) - 1
        rows.append(np.log((cells[kept] + config.smoothing) / (cells.sum(axis=0) + config.smoothing * (kept.sum() + 1))))
        return {key: first + int(places[i]) for i, key in enumerate(table.places) if kept[i]}

    by_word = logs(words, config.least_count)
    by_length: dict[str, int] = {}
    for tally in grams:
        by_length |= logs(tally)
        tally.places = {}
    return Model(languages, by_word, by_length, np.concatenate(rows), config.longest)


def cut(word: str, n: int) -> list[str]:
    """n-grams of a word between its edges; an edge alone is none."""
    edged = f"\x02{word}\x03"
    return [g for i in range(len(edged) - n + 1) if (g := edged[i:i + n]) not in ("\x02", "\x03")]


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.zero = np.zeros(len(model.languages))
        self.place: dict[str, int] = {}
        self.matrix = np.empty((1024, len(model.languages)))

    def word_scores(self, word: str) -> np.ndarray:
        known = self.model.words.get(word)
        if known is not None:
            return self.model.logs[known]
        for n in range(self.model.longest, 0, -1):
            found = [s for g in cut(word, n) if (s := self.model.grams.get(g)) is not None]
            if found:
                return self.model.logs[found].mean(axis=0)
        return self.zero

    def _place(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[at] = self.word_scores(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORDS.findall((text or "").lower())
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.place) > KNOWN_WORDS:
            self.place = {}
            self.matrix = np.empty((1024, len(self.model.languages)))
        places = [self.place[w] if w in self.place else self._place(w) for w in words]
        total = self.matrix[places].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], 1.0 / math.fsum(np.exp(total - total[best]))


def predict(df: DataFrame, model: Model, text: str = "text", result: str = "language") -> DataFrame:
    """Adds ``result``: struct of lang and score."""
    shared = with_workers(df.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predicted(texts: pa.Array) -> pa.Array:
        own = kept_by_worker("languages", shared.value, lambda: Predictor(shared.value))
        rows = [own.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"]
        )

    return df.withColumn(result, predicted.asNondeterministic()(F.col(text)))
