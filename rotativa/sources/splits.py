"""Corpora that come as one dataset per split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import SPLIT

# Names a split goes by, in the order they are looked for. Corpora and feature folders differ.
CORPUS_ALIASES = {
    "train": ("train",),
    "val": ("val", "valid", "validation", "dev", "development"),
    "test": ("test",),
}
FEATURE_ALIASES = {
    "train": ("train",),
    "val": ("val", "development", "dev", "valid", "validation"),
    "test": ("test",),
}


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def resolve_split(
    spark: SparkSession, folder: str, split: str, aliases: dict[str, Sequence[str]] = CORPUS_ALIASES,
    extension: str = ".parquet",
) -> str:
    """The first of the split's names that exists in the folder."""
    if split not in aliases:
        raise ValueError(f"unsupported split {split!r}; known: {sorted(aliases)}")
    tried = [f"{folder.rstrip('/')}/{name}{extension}" for name in aliases[split]]
    for path in tried:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no data for split {split!r}; looked for {tried}")


def read_splits(
    spark: SparkSession, folder: str, splits: Sequence[str] = ("train", "val", "test"),
    aliases: dict[str, Sequence[str]] = CORPUS_ALIASES, skip_missing: bool = False,
) -> DataFrame:
    """All splits as one table with a ``split`` column. A missing split is an error, unless it is to be skipped."""
    found = {}
    for split in splits:
        try:
            found[split] = resolve_split(spark, folder, split, aliases)
        except FileNotFoundError:
            if not skip_missing:
                raise
    if not found:
        raise FileNotFoundError(f"no split of {list(splits)} in {folder}")
    parts = [spark.read.parquet(path).withColumn(SPLIT, F.lit(split)) for split, path in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_splits(df: DataFrame, path: str) -> None:
    """One table, partitioned by split: a reader of one split opens only its files.

    Splits that ``df`` has replace those of the table; splits it lacks stay as they are.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SPLIT).parquet(path)
