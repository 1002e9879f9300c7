"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side with at most this many rows and bytes is broadcast, whatever the other side weighs.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 256
MIN_SUPPORT = 1e-4  # the smallest share freqItems takes


# Types whose bytes a row count bounds; anything else can hold any number of values.
PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def heavy_hitters(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Hashes of the keys that hold more than one shuffle partition's share of the rows, with their numbers of rows.

    A sketch of bounded state names candidates, none of the heavy ones missing; an exact count of those decides.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    support = max(MIN_SUPPORT, 1.0 / max(partitions, 2))
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    candidates = hashed.stat.freqItems(["h"], support).first()[0] or []  # at most 1 / support
    if not candidates:
        return {}
    of_key = F.when(F.col("h").isin(*candidates), F.col("h"))
    counts = {r["h"]: r["n"] for r in hashed.groupBy(of_key.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = support * sum(counts.values())
    return {h: n for h, n in sorted((h, n) for h, n in counts.items() if h is not None) if n > least}


def copies_of(heavy: dict[int, int], rows: int) -> dict[int, int]:
    """How many tasks each heavy key is spread over, in proportion to its rows."""
    return {h: max(2, min(SALTS, -(-n // max(1, rows)))) for h, n in heavy.items()}


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a side of a join may be broadcast: its rows and the bytes of its strings are counted, not guessed.

    Sides with arrays, maps, structs or binary values never are.
    """
    if rows <= 0 or not all(isinstance(f.dataType, PLAIN) for f in df.schema.fields):
        return False
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    width = F.lit(16 * len(df.columns))  # no plain value but a string is longer
    for name in strings:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salt_by: Sequence[str] = ()
) -> DataFrame:
    """Join to a side with at most one row per key; how is ``left`` or ``inner``. Null keys match nothing.

    Rows of heavy keys on the left are spread by a hash of ``salt_by`` (columns in which they differ), and only those
    keys are repeated on the right, as often as their rows fill partitions. The salt comes from the row itself, so a
    task that runs again after a lost executor sends each row to the same place.
    """
    keys = list(on)
    heavy = heavy_hitters(left, keys) if salt_by else {}
    if not heavy:
        return left.join(right, keys, how)
    copies = copies_of(heavy, min(heavy.values()))
    hashed = F.xxhash64(*keys)
    per_key = F.create_map(*[x for h, n in copies.items() for x in (F.lit(h), F.lit(n))])
    many = F.coalesce(F.try_element_at(per_key, hashed), F.lit(1))
    spread = F.pmod(F.xxhash64(*salt_by), many).cast("int")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")
