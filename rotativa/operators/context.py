"""Context block: hashed source, domain, topic and author, age in days, presence flags."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context as ctx
from .corpus import ID, require_columns


@dataclass(frozen=True)
class ContextConfig:
    """``as_of`` is the moment ages are measured from. There is no default: a rerun has to give the same ages."""

    as_of: datetime | None = None
    topic: str = "Topic"
    source: str = "Source"
    link: str = "Link"
    author: str | None = None
    date: str | None = None
    source_dim: int = 32
    domain_dim: int = 32
    topic_dim: int = 16
    author_dim: int = 16
    n_hashes: int = 2
    signed: bool = True
    l2_normalize: bool = True
    age_cap_days: float | None = ctx.AGE_CAP_DAYS
    missing_age: float = ctx.MISSING_AGE

    def __post_init__(self):
        if self.date and self.as_of is None:
            raise ValueError("a date column needs as_of")
        if self.as_of is not None and self.as_of.tzinfo is None:  # the same ages wherever the driver runs
            object.__setattr__(self, "as_of", self.as_of.replace(tzinfo=timezone.utc))

    @property
    def dims(self) -> dict[str, int]:
        return {
            "source": max(self.source_dim, 0), "domain": max(self.domain_dim, 0),
            "topic": max(self.topic_dim, 0), "author": max(self.author_dim, 0),
        }

    @property
    def names(self) -> tuple[str, ...]:
        hashed = [f"ctx_{field}_emb_{i}" for field, dim in self.dims.items() for i in range(dim)]
        return (*hashed, "ctx_age_days", *FLAG_NAMES)


FLAG_NAMES = tuple(f"ctx_has_{name}" for name in ("link", "domain", "source", "topic", "author", "date"))


def hash_embed(
    df: DataFrame, fields: dict[str, tuple[str, int]], n_hashes: int = 2, signed: bool = True,
    l2_normalize: bool = True, suffix: str = "_emb",
) -> DataFrame:
    """Add one ``array<double>`` per field; ``fields`` maps a field name to its value column and dimension.

    Two projections: the few (index, sign) pairs of a value, hashed once per row, and the vector with those pairs at
    their places, divided by its norm. Empty values give zeros, and so do signs that cancel.
    """
    hashes = range(max(n_hashes, 1))
    pairs, vectors = {}, {}
    for field, (column, dim) in fields.items():
        if dim <= 0:
            vectors[f"{field}{suffix}"] = F.array().cast("array<double>")
            continue
        keys = [ctx.hash_key(F.col(column), field, j) for j in hashes]
        given = ctx.str_field(F.col(column)) != ""
        pairs |= {f"_hx_{field}_i{j}": ctx.hash_index(keys[j], dim) for j in hashes}
        pairs |= {
            f"_hx_{field}_s{j}": F.when(given, ctx.hash_sign(keys[j], signed)).otherwise(0.0) for j in hashes
        }
        index = [F.col(f"_hx_{field}_i{j}") for j in hashes]
        sign = [F.col(f"_hx_{field}_s{j}") for j in hashes]
        vectors[f"{field}{suffix}"] = _placed(index, sign, dim, l2_normalize)
    return df.withColumns(pairs).withColumns(vectors).drop(*pairs) if pairs else df.withColumns(vectors)


def _placed(index: list[Column], sign: list[Column], dim: int, l2_normalize: bool) -> Column:
    """Signs summed at their indexes. Norm and sums are only worked out at the places that are hit."""
    square = F.lit(0.0)
    for i, s in zip(index, sign):
        for j, r in zip(index, sign):
            square = square + F.when(i == j, s * r).otherwise(0.0)

    def element(k: Column) -> Column:
        total = F.lit(0.0)
        for i, s in zip(index, sign):
            total = total + F.when(i == k, s).otherwise(0.0)
        if l2_normalize:
            total = total / F.when(square > 0, F.sqrt(square)).otherwise(1.0)
        return F.when(k.isin(*index), total).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), element)


def with_context_fields(df: DataFrame, config: ContextConfig) -> DataFrame:
    """Add ``_cx_*``: the five cleaned strings and the age."""
    require_columns(df, [c for c in (config.topic, config.source, config.link, config.author, config.date) if c])
    fields = {
        "_cx_topic": ctx.str_field(F.col(config.topic)),
        "_cx_source": ctx.str_field(F.col(config.source)),
        "_cx_link": ctx.str_field(F.col(config.link)),
        "_cx_date": ctx.str_field(F.col(config.date)) if config.date else F.lit(""),
    }
    given_author = F.col(config.author) if config.author else None
    age = F.lit(float(config.missing_age))
    if config.date:
        age = ctx.age_days(F.col("_cx_date"), F.lit(config.as_of), config.age_cap_days, config.missing_age)
    linked = df.withColumns(fields).withColumn("_cx_parts", ctx.url_parts(F.col("_cx_link")))
    return linked.withColumns({
        "_cx_domain": ctx.domain_of(F.col("_cx_parts")),
        "_cx_author": ctx.author(F.col("_cx_parts"), given_author),
        "_cx_age": age,
    })


def flags() -> dict[str, Column]:
    return {
        name: F.when(F.col("_cx_" + name.removeprefix("ctx_has_")) != "", F.lit(1.0)).otherwise(F.lit(0.0))
        for name in FLAG_NAMES
    }


def context_vectors(df: DataFrame, config: ContextConfig, keep: tuple[str, ...] = (ID,)) -> DataFrame:
    """Kept columns and the whole block packed into ``features array<double>``, in the order of ``config.names``."""
    fields = {field: (f"_cx_{field}", dim) for field, dim in config.dims.items()}
    out = hash_embed(
        with_context_fields(df, config), fields, config.n_hashes, config.signed, config.l2_normalize, "_cx_emb"
    )
    tail = F.array(F.col("_cx_age"), *flags().values())
    return out.select(*keep, F.concat(*[F.col(f"{field}_cx_emb") for field in fields], tail).alias("features"))


def context_features(df: DataFrame, config: ContextConfig, keep: tuple[str, ...] = (ID,)) -> DataFrame:
    """The same block with one column per feature."""
    packed = context_vectors(df, config, keep)
    return packed.select(*keep, *[F.col("features")[i].alias(name) for i, name in enumerate(config.names)])
