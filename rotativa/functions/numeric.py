"""Numeric safety: what is not a finite number becomes 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(c: Column, on: bool = True) -> Column:
    """A double; switched off, missing and non-finite values stay as they are."""
    c = c.cast("double")
    if not on:
        return c
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, c).otherwise(F.lit(0.0))


def safe_vector(c: Column, on: bool = True) -> Column:
    return F.transform(c, lambda x: safe(x, on))


def floor_one(c: Column) -> Column:
    """Denominator guard: counts are at least 1."""
    return F.greatest(c, F.lit(1))


def ratio(count: Column, total: Column) -> Column:
    return count.cast("double") / floor_one(total)
