"""The corpus table: checks, labels, nested records and text preparation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

ID, LABEL, SPLIT = "Id", "label", "split"


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table itself, or an error that lists what is missing and what is there. Needs no job."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def with_label(df: DataFrame, source: str = "Category") -> DataFrame:
    """``label`` as it is, else a copy of the category, else no label at all."""
    if LABEL in df.columns or source not in df.columns:
        return df
    return df.withColumn(LABEL, F.col(source))


def records_to_rows(
    df: DataFrame, text_col: str, id_col: str | None = None, data: str | None = None
) -> DataFrame:
    """Texts and ids from a flat table, or from an array of records in column ``data``.

    A record without text gives the empty string, an empty array no row; an id is optional.
    """
    if data is not None:
        df = df.select(F.inline(require_columns(df, [data])[data]))
    require_columns(df, [text_col])
    out = [text.text_or_empty(F.col(text_col)).alias("text")]
    if id_col and id_col in df.columns:
        out.append(F.col(id_col).alias("id"))
    return df.select(*out)


def json_records_to_rows(
    df: DataFrame, payload: str, text_col: str, id_col: str | None = None, data: str = "data", keep: Sequence[str] = ()
) -> DataFrame:
    """Texts and ids from untyped records: each value of ``payload`` is JSON text, whatever its shape.

    A list has its objects as records, and so has an object with a list in ``data``; any other object is a record by
    itself. Fields are looked up as they are found, so records need no common schema. A record without text, or with a
    null one, gives the empty string; numbers, lists and objects give their JSON text. An empty list, or null for a
    payload, gives no row. As with a table, the text field has to be there: the job fails if the first record of a
    payload lacks it, if a record is no object, and if a payload is no JSON. An id is optional and comes as text.
    ``keep`` are columns that go along.
    """
    whole = F.parse_json(F.col(payload))
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    records = F.coalesce(
        F.try_variant_get(whole, "$", "array<variant>"),
        F.try_variant_get(F.try_element_at(fields, F.lit(data)), "$", "array<variant>"),
        F.when(whole.isNotNull(), F.array(whole)),
    )
    names = {"_place": F.col("_place"), "_fields": F.try_variant_get("_record", "$", "map<string,variant>")}
    found = df.select(*keep, F.posexplode(records).alias("_place", "_record")).select(*keep, *[c.alias(n) for n, c in names.items()])
    absent = F.concat(
        F.lit(f"missing field '{text_col}'; available: "), F.array_join(F.map_keys("_fields"), ", ")
    )
    own = F.try_element_at("_fields", F.lit(text_col))
    value = (
        F.when(F.col("_fields").isNull(), F.raise_error(F.lit("a record is no object")))
        .when((F.col("_place") == 0) & ~F.map_contains_key("_fields", F.lit(text_col)), F.raise_error(absent))
        .otherwise(F.coalesce(_json_text(own), F.lit("")))
    )
    out = [value.alias("text")]
    if id_col:
        out.append(_json_text(F.try_element_at("_fields", F.lit(id_col))).alias("id"))
    return found.select(*keep, *out)


def _json_text(value: Column) -> Column:
    """A string as it is, anything else as JSON; null for JSON's null."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))


def id_integrity(df: DataFrame, id_col: str = ID) -> DataFrame:
    """One row: rows, distinct ids, rows without id, ids that occur more than once.

    Counting per id first keeps the work even when one id holds most rows: map-side partial counts.
    """
    per_id = require_columns(df, [id_col]).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(id_col).isNotNull()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(id_col).alias("n_ids"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(known & (F.col("n") > 1), 1)).alias("n_duplicated"),
    )


def preprocess(
    df: DataFrame, headline: str = "Headline", body: str = "Text", label: str = "Category",
    urls: bool = True, emails: bool = True,
) -> DataFrame:
    """Add ``text_raw``, ``text_xlmr`` and ``label``; other columns stay. Row-local: no shuffle, also on streams."""
    require_columns(df, [headline, body, label])
    return (
        df.withColumn("text_raw", text.join_headline_body(F.col(headline), F.col(body)))
        .withColumn("text_xlmr", text.clean_text(F.col("text_raw"), urls, emails))
        .withColumn(LABEL, F.col(label))
    )


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))
