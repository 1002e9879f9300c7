"""Feature blocks side by side, joined by id under a policy for missing rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe
from ..session import stored
from .corpus import ID, LABEL, require_columns
from .emotion import names_of
from .skew import salted_join

POLICIES = ("fill_zero", "drop", "error")
PREFIXES = {"sem": "sem_", "emo": "emo_", "sty": "sty_", "ctx": "ctx_"}
VECTOR = "features"


def prefix_names(names: Sequence[str], prefix: str, always: bool = False) -> list[str]:
    """Prefix all names, unless the first one has the prefix already."""
    if not always and names and names[0].startswith(prefix):
        return list(names)
    return [prefix + name for name in names]


@dataclass(frozen=True)
class Block:
    """``df`` has an id and a vector column. With ``order`` the last row of an id wins. Without it a side with repeated
    ids fails the job, and the rows of a base are taken as they stand. ``within`` names columns in whose values ids are
    apart, such as the split."""

    name: str
    df: DataFrame
    names: tuple[str, ...]
    order: str | None = None
    vector: str = VECTOR
    id_col: str = ID
    label: str = LABEL
    within: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(self.names))
        object.__setattr__(self, "within", tuple(self.within))
        require_columns(self.df, [*self.within, self.id_col, self.vector, *([self.order] if self.order else [])])

    @property
    def key(self) -> list[str]:
        return [*self.within, self.id_col]

    @property
    def dim(self) -> int:
        return len(self.names)

    @property
    def has_label(self) -> bool:
        return self.label in self.df.columns

    def last(self) -> DataFrame:
        """One row per id that is not null."""
        known = self.df.filter(F.col(self.id_col).isNotNull())
        if self.order is None:
            return only_row(known, self.key, self.vector, self.name)
        return dedupe_last(known, self.key, self.order)


def block_from_columns(
    name: str, df: DataFrame, features: Sequence[str], order: str | None = None, id_col: str = ID
) -> Block:
    """Pack named columns into a vector, with the names prefixed for the merged table."""
    keep = [c for c in (id_col, LABEL, order) if c and c in df.columns]
    packed = columns_to_vector(df, features, keep)
    return Block(name, packed, tuple(prefix_names(features, PREFIXES[name])), order, id_col=id_col)


def semantic_block(df: DataFrame, dim: int, order: str | None = None, id_col: str = ID) -> Block:
    require_columns(df, [id_col, "sem_emb"])
    names = prefix_names([f"sem_emb_{i}" for i in range(dim)], PREFIXES["sem"], always=True)
    return Block("sem", df, tuple(names), order, "sem_emb", id_col)


def emotion_hstack(df: DataFrame) -> DataFrame:
    """Add the emotion, sentiment and signal vectors of a row as one."""
    parts = ["emo_probs", "sent_probs", "signals"]
    require_columns(df, parts)
    return df.withColumn(VECTOR, F.concat(*parts))


def emotion_names(df: DataFrame, dim: int | None = None) -> list[str]:
    """Names from the schema of the three vectors, else numbered ones."""
    emo, sent, signals = (names_of(df, c) for c in ("emo_probs", "sent_probs", "signals"))
    if emo and sent and signals:
        names = [f"emo_{n}" for n in emo] + [f"sent_{n}" for n in sent] + signals
    elif dim is None:
        raise ValueError("the vectors carry no names: give their total length")
    else:
        names = [f"emo_feat_{i}" for i in range(dim)]
    return prefix_names(names, PREFIXES["emo"], always=True)


def emotion_block(df: DataFrame, dim: int | None = None, order: str | None = None, id_col: str = ID) -> Block:
    require_columns(df, [id_col])
    return Block("emo", emotion_hstack(df), tuple(emotion_names(df, dim)), order, id_col=id_col)


def columns_to_vector(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (ID,)) -> DataFrame:
    return df.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias(VECTOR))


def vector_to_columns(
    df: DataFrame, names: Sequence[str], vector: str = VECTOR, keep: Sequence[str] = (ID,)
) -> DataFrame:
    """One column per name. A vector of another length fails the job; a null vector gives nulls."""
    v = F.col(vector)
    wrong = F.raise_error(F.concat(F.lit(f"{len(names)} names for a vector of length "), F.size(v).cast("string")))
    checked = F.when(v.isNull() | (F.size(v) == len(names)), v).otherwise(wrong)
    cells = df.select(*keep, checked.alias("_v"))
    return cells.select(*keep, *[F.get("_v", F.lit(i)).alias(name) for i, name in enumerate(names)])


def align_features(
    df: DataFrame, names: Sequence[str], keep: Sequence[str] = (ID,), safe_numeric: bool = True
) -> DataFrame:
    """The named features in this order; one the table lacks is 0, as is a value that is no number unless switched off."""
    return df.select(*keep, *[(safe(F.col(n), safe_numeric) if n in df.columns else F.lit(0.0)).alias(n) for n in names])


def dedupe_last(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``. Partial maxima first: a key with many copies is thinned map-side.

    A row without order comes before all others; of rows with the same order that with the largest hash is the last.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*rest))
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*df.columns)


def only_row(df: DataFrame, key: Sequence[str], vector: str, name: str) -> DataFrame:
    """The rows, but a failed job where a key has several, as nothing tells which of them counts.

    Rows are numbered within their key, in the layout that the join by key needs anyway: nothing else is shuffled or
    sorted, and the vectors go through no aggregate.
    """
    message = F.concat(F.lit("repeated id="), F.col(key[-1]).cast("string"), F.lit(f" in block '{name}': give an order"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    checked = F.when(F.col("_n") == 1, F.col(vector)).otherwise(F.raise_error(message))
    return df.withColumn("_n", number).withColumn(vector, checked).drop("_n")


def check_dim(vector: Column, block: Block, id_value: Column) -> Column:
    """The vector, or a failed job if its length is not that of the block."""
    message = F.concat(
        F.lit("dimension mismatch for id="), id_value.cast("string"),
        F.lit(f" block={block.name}: expected {block.dim}, got "), F.size(vector).cast("string"),
    )
    return F.when(F.size(vector) == block.dim, vector).otherwise(F.raise_error(message))


def dim_violations(block: Block) -> DataFrame:
    """Rows whose vector length is wrong, per length."""
    size = F.size(block.vector)
    return block.df.filter(size != block.dim).groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def _part(block: Block, policy: str) -> Column:
    """A block's share of the merged vector."""
    v, id_value = F.col(f"_v_{block.name}"), F.col(ID)
    if policy == "error":
        missing = F.raise_error(
            F.concat(F.lit("missing id="), id_value.cast("string"), F.lit(f" in block '{block.name}'"))
        )
    else:
        missing = F.array_repeat(F.lit(0.0).cast("float"), block.dim)
    return F.when(v.isNull(), missing).otherwise(check_dim(v, block, id_value)).cast("array<float>")


def merge_blocks(
    blocks: Sequence[Block], policy: str = "fill_zero", flags: bool = True
) -> DataFrame:
    """``[within,] Id, [label,] features``: the blocks of each base row one after the other, then the presence flags.

    The first block is the base. All sides have one row per id when they meet, so no join can blow up or get hot;
    each block is shuffled once and the joins share that partitioning. A base with an order is stored first, so that it
    runs once; its last vectors are merged, and its rows are put back at the end, by a join that spreads ids with many
    copies. Labels come from the base, or by id from the first block that has some. Under ``drop`` all copies of an id
    get the label of the last. Base rows with a null id match no side: they stay with their own vector under
    ``fill_zero``, go under ``drop`` and fail under ``error`` if there are other blocks.
    """
    policy = (policy or "fill_zero").lower().strip()
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    base, rest = blocks[0], blocks[1:]
    within = list(base.within)
    if any(list(block.within) != within for block in rest):
        raise ValueError(f"blocks differ in what their ids are unique within: {[b.within for b in blocks]}")
    if base.order is not None:
        used = dict.fromkeys([*base.key, base.vector, base.order, *([base.label] if base.has_label else [])])
        base = replace(base, df=stored(base.df.select(*used), "base"))
        blocks = [base, *rest]
    labelled = next((b for b in blocks if b.has_label), None)
    label_per_row = labelled is base and policy != "drop"

    def side(block: Block) -> DataFrame:
        label = [F.col(block.label).alias(LABEL)] if block is labelled else []
        vector = F.col(block.vector).cast("array<float>").alias(f"_v_{block.name}")
        if block is not base:
            rows = block.last()
        else:
            rows = block.df if block.order is None else dedupe_last(block.df, block.key, block.order)
        return rows.select(*within, F.col(block.id_col).alias(ID), vector, *label)

    wide = side(base)
    for block in rest:
        wide = wide.join(side(block), [*within, ID], "inner" if policy == "drop" else "left")
    if policy == "drop":
        for block in blocks:
            wide = wide.filter(F.col(f"_v_{block.name}").isNotNull())

    parts = [_part(block, policy) for block in blocks]
    if flags:
        present = [F.col(f"_v_{b.name}").isNotNull().cast("float") for b in blocks]
        parts.append(F.array(*present))
    keep = [*within, ID, LABEL] if labelled else [*within, ID]
    merged = wide.select(*keep, F.concat(*parts).alias(VECTOR))
    if base.order is None:
        return merged

    copies = base.df.select(
        *within, F.col(base.id_col).alias(ID), F.col(base.order).alias("_order"),
        *([F.col(base.label).alias(LABEL)] if label_per_row else []),
    )
    right = merged.drop(LABEL) if label_per_row else merged
    # Null ids meet as well: the key is the id and whether there is one.
    key = {}
    for i, c in enumerate([*within, ID]):
        key |= {f"_null{i}": F.col(c).isNull(), f"_key{i}": F.coalesce(F.col(c).cast("string"), F.lit(""))}
    found = salted_join(copies.withColumns(key), right.withColumns(key).drop(*within, ID), list(key), "inner", ["_order"])
    return found.select(*keep, VECTOR)


def presence(blocks: Sequence[Block]) -> DataFrame:
    """``[within,] Id`` and a double ``has_<block>`` for each block: the flags of ``merge_blocks`` under ``fill_zero``.

    Only ids meet, and whether there is a vector: vectors are neither shuffled nor, where they can't be null, computed. Their
    lengths are not checked. Among rows of an id with the same order a hash of the whole row decides which is the last:
    with an order, flags come from the merged vectors.
    """
    base, rest = blocks[0], blocks[1:]
    within = list(base.within)
    flags = [f"has_{block.name}" for block in blocks]
    if any(block.order is not None for block in blocks):
        first = sum(block.dim for block in blocks)
        merged = merge_blocks(blocks)
        return merged.select(*within, ID, *[F.get(VECTOR, F.lit(first + i)).cast("double").alias(name) for i, name in enumerate(flags)])
    if any(list(block.within) != within for block in rest):
        raise ValueError(f"blocks differ in what their ids are unique within: {[b.within for b in blocks]}")

    def side(block: Block) -> DataFrame:
        known = block.df.select(*block.key, F.col(block.vector).isNotNull().alias(block.vector))
        rows = known if block is base else replace(block, df=known).last()
        return rows.select(*within, F.col(block.id_col).alias(ID), F.col(block.vector).alias(f"has_{block.name}"))

    wide = side(base)
    for block in rest:
        wide = wide.join(side(block), [*within, ID], "left")
    return wide.select(*within, ID, *[F.coalesce(name, F.lit(False)).cast("double").alias(name) for name in flags])


def merged_names(blocks: Sequence[Block], flags: bool = True) -> list[str]:
    names = [name for block in blocks for name in block.names]
    return names + [f"has_{block.name}" for block in blocks] if flags else names


def block_slices(blocks: Sequence[Block], flags: bool = True) -> list[tuple[str, int, int]]:
    """Where each block lies in the merged vector: name, start, end."""
    dims = [(block.name, block.dim) for block in blocks] + ([("flags", len(blocks))] if flags else [])
    out, start = [], 0
    for name, dim in dims:
        out.append((name, start, start + dim))
        start += dim
    return out
