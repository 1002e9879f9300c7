"""Models of the user's own, run on Arrow batches inside the tasks.

``load`` is called once per partition and returns the model. Texts reach it in batches of ``batch_size``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .corpus import ID, require_columns


def predict_all(model: Any, texts: list[str], batch_size: int) -> list[Any]:
    """One result per text: by ``predict_many``, by ``predict`` on a list, or text by text."""
    size = max(int(batch_size), 1)
    if hasattr(model, "predict_many"):
        out = list(model.predict_many(texts, batch_size=size))
    else:
        out = []
        for start in range(0, len(texts), size):
            chunk = texts[start:start + size]
            try:
                got = model.predict(chunk)
            except (TypeError, AttributeError, ValueError):
                got = None
            out += got if isinstance(got, list) else [model.predict(text) for text in chunk]
    if len(out) != len(texts):
        raise RuntimeError(f"model returned {len(out)} predictions for {len(texts)} texts")
    return out


def _per_batch(
    df: DataFrame, text: str, out: str, out_type: T.DataType, keep: Sequence[str],
    load: Callable[[], Any], apply: Callable[[Any, list[str]], list[Any]],
) -> DataFrame:
    source = require_columns(df, [*keep, text]).select(*keep, text)
    schema = T.StructType([*[source.schema[name] for name in keep], T.StructField(out, out_type)])
    names = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts = batch[text].fillna("").astype(str).tolist()
            result = batch[names].copy()
            result[out] = apply(model, texts)
            yield result

    return source.mapInPandas(run, schema)


def score_documents(
    df: DataFrame, text: str, load: Callable[[], Any], batch_size: int = 32, keep: Sequence[str] = (ID,),
    out: str = "probas",
) -> DataFrame:
    """Class probabilities as a map. The model gives dicts, or objects with a ``probas`` dict."""

    def apply(model: Any, texts: list[str]) -> list[Any]:
        found = predict_all(model, texts, batch_size)
        return [dict(getattr(one, "probas", one)) for one in found]

    return _per_batch(df, text, out, T.MapType(T.StringType(), T.DoubleType()), keep, load, apply)


def embed_documents(
    df: DataFrame, text: str, load: Callable[[], Any], batch_size: int = 8, keep: Sequence[str] = (ID,),
    out: str = "sem_emb",
) -> DataFrame:
    """One vector per text. The model encodes a list of texts; rows are told apart by their id, not by position."""

    def apply(model: Any, texts: list[str]) -> list[Any]:
        vectors: list[Any] = []
        for start in range(0, len(texts), max(batch_size, 1)):
            vectors += [[float(x) for x in v] for v in model.encode(texts[start:start + max(batch_size, 1)])]
        if len(vectors) != len(texts):
            raise RuntimeError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
        return vectors

    return _per_batch(df, text, out, T.ArrayType(T.FloatType()), keep, load, apply)
