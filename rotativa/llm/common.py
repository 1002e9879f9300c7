"""Small helpers the operators share."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import rotativa

from ..session import scratch_path, shared_folder, ship


BATCH_BYTES = 4 << 20


def with_workers(spark: SparkSession) -> SparkSession:
    """Python workers import this package; where it isn't installed on them, it is sent along once.

    Texts go to them in batches of about ``BATCH_BYTES``: long texts would otherwise come ten thousand at a time.
    """
    ship(spark, rotativa)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used, inside of lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SCAN_BLOCK = 64
SCAN_LEVELS = 2


def scan(values: Column, join, levels: int = SCAN_LEVELS) -> Column:
    """Running results of ``join`` (associative) over an array: element i joins the values up to and with i.

    A fold that appends copies its array each time. So blocks of 64 are scanned by themselves, and so are their last
    results, level by level: time in proportion to the array times a block, up to millions of values.
    """
    def fold(block: Column) -> Column:
        first = F.slice(block, F.lit(1), F.lit(1))
        return F.aggregate(F.slice(block, F.lit(2), F.greatest(F.size(block) - 1, F.lit(0))), first, lambda acc, x: F.concat(
            acc, F.array(join(F.element_at(acc, -1), x))
        ))

    if not levels:
        return fold(values)

    def blockwise(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SCAN_BLOCK).cast("int"))
        return let(F.transform(starts, lambda b: fold(F.slice(all_, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))), together)

    def together(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda block: F.element_at(block, -1)), join, levels - 1)
        return let(before, lambda ends: F.flatten(F.transform(blocks, lambda block, b: F.when(b == 0, block).otherwise(
            F.transform(block, lambda x: join(F.get(ends, b - 1), x))
        ))))

    return let(values, lambda all_: F.when(F.size(all_) <= SCAN_BLOCK, F.when(F.size(all_) == 0, all_).otherwise(fold(all_))).otherwise(blockwise(all_)))


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as decimal text, modulo ``folds``; a null key is in fold -1, so it is neither held out nor lost."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the folder all executors share and read it from there: lineage ends, sizes are known."""
    shared_folder(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 500_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """A side of a join with plain columns of a few bytes, stored and counted: broadcast up to ``SMALL_ROWS`` rows (under
    50 MB), joined by a shuffle of both sides beyond."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


HOT_SHARE = 1_000  # a key with one in so many rows is hot; there are at most so many


def join_spread(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``side`` for its key; ``n`` in ``side`` counts a key's rows, of ``total`` in all.

    Rows of a hot key would meet in one task. There are few such keys, so they are broadcast; the others are shuffled.
    Both are read from where they are stored.
    """
    hot = F.col(n) * HOT_SHARE >= total
    few, rest = F.broadcast(side.where(hot)), side.where(~hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict[str, tuple[object, object]] = {}


def kept_by_worker(name: str, source: object, build):
    """What ``build`` makes from a broadcast value, once per worker process.

    Workers are reused by later stages, so a worker keeps one such table: those of earlier operators go.
    """
    if name not in _kept or _kept[name][0] is not source:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _kept[name] = source, build()
    return _kept[name][1]


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
