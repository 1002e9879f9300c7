"""Document vectors from token vectors ``Id, pos, mask, emb``.

Every pooling is a weighted vector mean with map-side partial sums, so a text that holds most of all tokens costs no
more than any other: no text's tokens are ever gathered in one place. A vector that is null or of another length than
``dim`` fails the job on every path, masked or not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as w

from .corpus import ID, LABEL, require_columns, with_label

MAX_TOKENS = 256
POOLINGS = ("mean", "cls", "attention")

# Weight of a masked token beside unmasked ones: it drowns in rounding, unless a text has masked tokens only, which
# then all weigh the same - what a softmax over equal scores gives.
MASKED_WEIGHT = 1e-290

# Attention scores lie within +-sum(|v|), as tanh lies within +-1. Up to 300 exp() of them lies within 1e-131 and 1e131:
# sums of 1e150 such weights are finite, and the smallest is still 1e159 times MASKED_WEIGHT. So no shift is needed.
SAFE_SCORE = 300.0

# Up to this many weights the score is a Spark expression; beyond it a matrix product on Arrow batches: the same score.
EXPRESSION_WEIGHTS = 1024


def truncate_tokens(tokens: DataFrame, max_len: int = MAX_TOKENS, id_col: str = ID) -> DataFrame:
    """The first tokens of each text. Spark cuts each partition's share down before it shuffles."""
    order = w.Window.partitionBy(id_col).orderBy("pos")
    return tokens.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_len).drop("_rank")


def of_length(emb: Column, dim: int) -> Column:
    """The vector as doubles, or a failed job."""
    found = F.coalesce(F.size(emb).cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit(f"a token vector has not {dim} dimensions but "), found))
    return F.when(emb.isNotNull() & (F.size(emb) == dim), emb).otherwise(wrong).cast("array<double>")


def _weighted_mean(tokens: DataFrame, emb: Column, weight: Column, id_col: str) -> DataFrame:
    """One aggregate whatever the number of dimensions; no weight may be 0, as such rows would not count at all."""
    rows = tokens.select(id_col, array_to_vector(emb).alias("_v"), weight.cast("double").alias("_w"))
    pooled = rows.groupBy(id_col).agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_mean"))
    return pooled.select(id_col, vector_to_array("_mean").alias("sem_emb"))


def pool_mean(tokens: DataFrame, dim: int, id_col: str = ID) -> DataFrame:
    """Mean over unmasked tokens; a text without any gives zeros."""
    emb, masked = of_length(F.col("emb"), dim), F.coalesce(F.col("mask"), F.lit(0)) == 0
    shown = F.when(masked, F.transform(emb, lambda x: F.lit(0.0))).otherwise(emb)
    return _weighted_mean(tokens, shown, F.when(masked, MASKED_WEIGHT).otherwise(F.col("mask")), id_col)


def pool_cls(tokens: DataFrame, id_col: str = ID) -> DataFrame:
    """The vector of the first token."""
    return tokens.groupBy(id_col).agg(F.min_by("emb", "pos").cast("array<double>").alias("sem_emb"))


def attention_score(
    emb: Column, projection: Sequence[Sequence[float]], bias: Sequence[float], v: Sequence[float]
) -> Column:
    """``v . tanh(P emb + b)``, with one row of ``P`` per attention unit."""
    score = F.lit(0.0)
    for row, b, weight in zip(projection, bias, v, strict=True):
        dot = F.aggregate(
            F.zip_with(emb, F.array(*map(F.lit, map(float, row))), lambda x, y: x * y), F.lit(float(b)),
            lambda acc, x: acc + x,
        )
        score = score + F.lit(float(weight)) * F.tanh(dot)
    return score


def with_attention_scores(
    tokens: DataFrame, projection: Sequence[Sequence[float]], bias: Sequence[float], v: Sequence[float]
) -> DataFrame:
    """Add ``_score``. Learned weights (hundreds of units on a thousand dimensions) do not belong in an expression."""
    if sum(len(row) for row in projection) <= EXPRESSION_WEIGHTS:
        return tokens.withColumn("_score", attention_score(F.col("emb"), projection, bias, v))
    p, b, out = np.asarray(projection, float), np.asarray(bias, float), np.asarray(v, float)
    schema = T.StructType([*tokens.schema.fields, T.StructField("_score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                hidden = np.tanh(np.stack(batch["emb"].to_list()) @ p.T + b)
                yield batch.assign(_score=hidden @ out)

    return tokens.mapInPandas(score, schema)


def pool_attention(
    tokens: DataFrame, dim: int, projection: Sequence[Sequence[float]], bias: Sequence[float],
    v: Sequence[float], id_col: str = ID,
) -> DataFrame:
    """Softmax-weighted mean with given weights, in one aggregation.

    The largest possible score is known from ``v``, so the usual shift by the largest actual score, and with it a
    second pass and a join, is only needed for extreme weights.
    """
    bound = sum(abs(float(x)) for x in v)
    checked = tokens.select(id_col, "mask", of_length(F.col("emb"), dim).alias("emb"))
    scored = with_attention_scores(checked, projection, bias, v)
    if bound > SAFE_SCORE:
        top = scored.filter(F.col("mask") != 0).groupBy(id_col).agg(F.max("_score").alias("_top"))
        scored = scored.join(top, id_col, "left")
        shifted = F.col("_score") - F.coalesce("_top", F.lit(0.0))
    else:
        shifted = F.col("_score")
    weight = F.when(F.col("mask") != 0, F.exp(shifted)).otherwise(F.lit(MASKED_WEIGHT))
    return _weighted_mean(scored, F.col("emb"), weight, id_col)


def semantic_frame(
    df: DataFrame, vectors: DataFrame, pooling: str, model_name: str, max_len: int = MAX_TOKENS, id_col: str = ID
) -> DataFrame:
    """``Id, label, sem_emb`` and the settings; texts without vector drop out of nothing: they keep a null vector."""
    if pooling not in POOLINGS:
        raise ValueError(f"pooling must be one of {POOLINGS}, got {pooling!r}")
    labelled = with_label(require_columns(df, [id_col]))
    keep = [id_col, LABEL] if LABEL in labelled.columns else [id_col]
    return labelled.select(*keep).join(vectors.select(id_col, "sem_emb"), id_col, "left").select(
        *keep, "sem_emb", F.lit(pooling).alias("pooling"), F.lit(model_name).alias("model_name"),
        F.lit(max_len).alias("max_len"),
    )
