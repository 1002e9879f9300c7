"""Registry, shared inputs and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rotativa
from rotativa.functions.chars import EMOJI
from rotativa.session import read_table, scratch_path, ship



def ranges(points) -> str:
    """Code points as the inside of a [...] class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


# Classes as the SQL means them, from Python's own tables and not from the code they check. Python has none of emoji.
CODE_POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
WORD = r"\p{L}\p{N}_"
SPACE = ranges(c for c in CODE_POINTS if chr(c).isspace())
SPACE_CHARS = "".join(chr(c) for c in CODE_POINTS if chr(c).isspace())
DIGITS = ranges(c for c in CODE_POINTS if chr(c).isdigit())

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf.rstrip('/')}/{name}.parquet", list(columns))


# Something of everything the documents themselves lack, after each whole text.
TAIL_START = (
    " ¿Qué pasó? Escribe a redacción@diario-nuevo.example, o a ana.ruiz@correo.example.org. "
    "Mira HTTPS://Www.Ejemplo.example/nota?id="
)
TAIL_END = (
    ", y www.otro.example/x). ¡Increíble!! ¿¿Por qué?? Dicen que se sabrá... según “fuentes” 50% más²: "
    "impactante, podría ser 'urgente'​😀👍🏽 ℹ﻿ fin_1   "
)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A derived input as a user would have it: written once, in the shared folder, and read as often as needed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_workers(spark: SparkSession) -> None:
    """Stand-in models live in this package, so the Python workers need it."""
    import checks

    ship(spark, rotativa, checks)


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", *more).withColumnRenamed("doc_id", "Id")


def tailed(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.concat("text", F.lit(TAIL_START), F.col("Id").cast("string"), F.lit(TAIL_END))
    return documents(spark, sf).select("Id", whole.alias("Text"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("Id"), "quality")
    links = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("Id"), "url")
    part = F.when(F.col("Id") % 10 < 8, "train").when(F.col("Id") % 10 == 8, "val").otherwise("test")
    return docs.join(labels, "Id", "left").join(links, "Id", "left").select(
        "Id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("Headline"), F.col("text").alias("Text"),
        F.col("quality").cast("string").alias("Category"), F.col("lang").alias("Topic"),
        F.col("source").alias("Source"), F.col("url").alias("Link"), part.alias("split"),
    )


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


TAILED = f"(SELECT doc_id AS Id, text || {q(TAIL_START)} || doc_id || {q(TAIL_END)} AS Text FROM documents)"
PLAIN = "(SELECT doc_id AS Id, text AS Text FROM documents)"
NEWS = """(SELECT d.doc_id AS Id, split_part(d.text, chr(10), 1) AS Headline, d.text AS Text,
  CAST(l.quality AS VARCHAR) AS Category, d.lang AS Topic, d.source AS Source, p.url AS Link,
  CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""

W = q(f"[{WORD}]+")


def s_strip(x: str) -> str:
    return f"trim({x}, {q(SPACE_CHARS)})"


def s_sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, {W})"


def s_lower_words(x: str) -> str:
    return f"list_transform({s_words(x)}, lambda w: lower(w))"


def s_count(x: str, *chars: str) -> str:
    out = x
    for ch in chars:
        out = f"replace({out}, {q(ch)}, '')"
    return f"(length({x}) - length({out}))"


def s_runs(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def s_hits(words: str, listed) -> str:
    return f"len(list_filter({words}, lambda w: w IN ({', '.join(map(q, listed))})))"


def s_ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / greatest({d}, 1))"


def s_sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_inside(x: str, inner: str) -> str:
    return f"length({s_sub(x, f'[^{inner}]+')})"


S_PUNCT_CLASS = rf"\p{{L}}\p{{N}}{SPACE}"
S_DIGITS = DIGITS
S_EMOJI = EMOJI
S_SPACE = SPACE
QUOTES = ('"', "“", "”", "'")

CONTROLS = r"[\x00-\x1f\x7f-\x9f\x{200b}\x{200c}\x{200d}\x{feff}]"
URL = rf"(?i)(https?://[^{SPACE}]+|www\.[^{SPACE}]+)"
EMAIL = rf"[{WORD}][{WORD}.\-]*@[{WORD}.\-]+\.[{WORD}]+"


def s_clean(x: str) -> str:
    masked = s_sub(s_sub(s_sub(x, CONTROLS, " "), URL, "<URL>"), EMAIL, "<EMAIL>")
    return s_strip(s_sub(masked, f"[{SPACE}]+", " "))


def s_round(x: str, places: int = 6) -> str:
    return f"round({x}, {places})"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})
