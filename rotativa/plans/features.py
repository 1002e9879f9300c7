"""From a corpus with a ``split`` column to feature blocks and the merged matrix."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emotion as em
from ..functions import style as st
from ..functions.emotion import SignalConfig
from ..functions.style import StyleConfig
from ..operators import context as cx
from ..operators import corpus as co
from ..operators import merge as mg
from ..operators import style as sty
from ..operators.context import ContextConfig
from ..operators.corpus import ID, LABEL, SPLIT
from ..operators.merge import Block, block_from_columns
from ..session import setting
from ..sources.blocks import first_existing, read_block, write_block
from ..sources.splits import read_splits, write_splits

BLOCKS = ("sem", "emo", "sty", "ctx")


@dataclass(frozen=True)
class FeatureConfig:
    context: ContextConfig
    style: StyleConfig = field(default_factory=StyleConfig)
    signals: SignalConfig = field(default_factory=SignalConfig)
    style_text: str = "Text"
    signal_text: str = "text_xlmr"


def preprocess_corpus(spark: SparkSession, folder: str, out: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """The splits of a folder, cleaned, as one table partitioned by split; splits that aren't asked for stay as they are."""
    write_splits(co.preprocess(read_splits(spark, folder, splits)), out)
    return spark.read.parquet(out)


def style_block(df: DataFrame, config: StyleConfig = StyleConfig(), text: str = "Text", **inputs) -> Block:
    """The style block of a corpus; ``tokens`` and ``lexicon`` as in ``style_features``."""
    return block_from_columns("sty", sty.style_features(df, text, config, **inputs), config.names)


def context_block(df: DataFrame, config: ContextConfig) -> Block:
    return Block("ctx", cx.context_vectors(df, config), config.names)


def local_features(df: DataFrame, config: FeatureConfig) -> DataFrame:
    """Emotion signals, style and context of each article in one scan and no shuffle.

    What is merged by id elsewhere stands in the same row here from the start: ``Id, [label, split,] signals, style,
    context``, one vector each. Works on a stream of articles as well.
    """
    keep = [c for c in (ID, LABEL, SPLIT) if c in df.columns]
    style_columns = st.core_features(config.style)
    if config.style.extra_signals:
        style_columns |= st.signal_features(config.style)
    same = config.signal_text == config.style_text
    counted = st.with_style_counts(em.with_signal_counts(df, config.signal_text), config.style_text, config.style, signals=same)
    kept_fields = [c for c in (config.context.topic, config.context.source, config.context.link,
                               config.context.author, config.context.date) if c]
    vectors = counted.select(
        *dict.fromkeys([*keep, *kept_fields]),
        F.array(*em.signal_features(config.signals).values()).alias("signals"),
        F.array(*style_columns.values()).alias("style"),
    )
    packed = cx.context_vectors(vectors, config.context, (*keep, "signals", "style"))
    return packed.withColumnRenamed(mg.VECTOR, "context")


def merge_splits(
    spark: SparkSession, folders: dict[str, Sequence[str]], out: str, splits: Sequence[str] = ("train", "val", "test"),
    policy: str = "fill_zero", flags: bool = True, orders: dict[str, str] | None = None,
) -> list[str]:
    """Merge stored blocks split by split; ``folders`` maps a block to the folders it may lie in, first choice first.

    Fails before any work if a block of any split is missing. Beside each merged table lies its description: names,
    slices, dimensions, policy and sources.
    """
    missing = [name for name in BLOCKS if name not in folders]
    if missing:
        raise ValueError(f"missing blocks {missing}; given: {sorted(folders)}")
    sources = {
        split: {name: first_existing(spark, [f"{f.rstrip('/')}/{split}" for f in folders[name]]) for name in BLOCKS}
        for split in splits
    }
    written = []
    for split, paths in sources.items():
        blocks = [read_block(spark, paths[name], (orders or {}).get(name)) for name in BLOCKS]
        merged = mg.merge_blocks(blocks, policy, flags)
        result = Block("merged", merged, tuple(mg.merged_names(blocks, flags)))
        target = f"{out.rstrip('/')}/{split}"
        write_block(result, target, {
            "split": split, "missing_policy": policy, "add_presence_flags": flags, "sources": paths,
            "blocks": mg.block_slices(blocks, flags), "dims": {b.name: b.dim for b in blocks} | {"total": len(result.names)},
        })
        written.append(target)
    return written


def merge_all(
    blocks: Sequence[Block], out: str, splits: Sequence[str] = ("train", "val", "test"), policy: str = "fill_zero", flags: bool = True,
) -> DataFrame:
    """Merge all splits of the blocks in one job and return its run metrics; ids are unique within a split.

    The blocks have a split column in ``within``. Stored by ``save_bucketed`` with the same number of buckets, they are
    joined bucket by bucket: no row is shuffled, and each task writes its rows of every split. The result is one version
    of the block at ``out`` with one description for all splits in it; splits left out of ``splits`` stay as they are.
    """
    (split,), base = blocks[0].within, blocks[0]
    wanted = [replace(b, df=b.df.where(F.col(split).isin(*splits))) for b in blocks]
    # Rows dealt out by id are in place for a join by split and id as well.
    with setting(base.df.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        merged = mg.merge_blocks(wanted, policy, flags)
        result = Block("merged", merged, tuple(mg.merged_names(blocks, flags)), within=(split,))
        return write_block(result, out, {
            "splits": list(splits), "missing_policy": policy, "add_presence_flags": flags, "blocks": mg.block_slices(blocks, flags),
            "dims": {b.name: b.dim for b in blocks} | {"total": len(result.names)},
        }, partition_by=(split,), parts=list(splits))


def settings_of(config) -> dict:
    """A configuration as plain values, for the description beside a block."""
    return json.loads(json.dumps(asdict(config), default=str))
