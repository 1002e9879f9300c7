"""Feature blocks on disk: the vectors as Parquet, names and settings in a small table beside them.

A block is a folder of versions. ``data/version=n`` holds vectors, ``meta/version=n`` their names, settings and the
parts (splits, say) they cover. The description is written last and read first: a version without a finished one doesn't
exist for readers, so vectors are never read under the names of another run, and whoever writes one part leaves the
others as they are. Earlier versions stay until ``drop_old_versions``, so a reader that has begun isn't disturbed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import Block
from ..session import setting
from .splits import children, path_exists

META_SCHEMA = "position int, name string, block string, settings string, created_at string, part string, columns string"


def _meta(spark: SparkSession, block: Block, settings: dict[str, Any], parts: Sequence[str] | None) -> DataFrame:
    created = datetime.now(timezone.utc).isoformat()
    text = json.dumps(settings, default=str, sort_keys=True)
    columns = block.df.schema.json()
    rows = [(i, name, block.name, text, created, part, columns) for part in parts or [None] for i, name in enumerate(block.names)]
    return spark.createDataFrame(rows, META_SCHEMA).coalesce(1)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.removeprefix("version=")) for name in children(spark, folder) if name.startswith("version="))


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose description was written to the end, oldest first."""
    root = path.rstrip("/")
    return [n for n in _versions(spark, f"{root}/meta") if path_exists(spark, f"{root}/meta/version={n}/_SUCCESS")]


def write_block(
    block: Block, path: str, settings: dict[str, Any] | None = None, partition_by: Sequence[str] = (),
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """Write vectors and names as a new version; returns one row of run metrics.

    With ``parts`` the block is partitioned by one column, and the version holds these values of it; other values are
    read from the versions that have them. Counts are observed while the rows are written, so the input is computed
    once. A wrong vector length fails here. A version begun by another writer in the meantime fails the later one.
    """
    if parts is not None and len(partition_by) != 1:
        raise ValueError("parts are values of one partition column")
    spark, root = block.df.sparkSession, path.rstrip("/")
    version = 1 + max([0, *_versions(spark, f"{root}/data"), *_versions(spark, f"{root}/meta")])
    size = F.size(block.vector)
    checked = block.df.withColumn(
        block.vector,
        F.when(size == block.dim, F.col(block.vector)).otherwise(
            F.raise_error(F.concat(F.lit(f"block {block.name}: expected {block.dim} features, got "), size.cast("string")))
        ),
    )
    return run_log(
        checked, f"{root}/data/version={version}", block.name, {"feature_dim": block.dim} | (settings or {}), partition_by,
        after=lambda: _meta(spark, block, settings or {}, parts).write.parquet(f"{root}/meta/version={version}"),
        mode="errorifexists",
    )


def run_log(
    df: DataFrame, path: str, step: str, settings: dict[str, Any], partition_by: Sequence[str] = (), after=None,
    mode: str = "overwrite",
) -> DataFrame:
    """Write a table and return one row: step, rows, columns, seconds, settings."""
    seen = Observation()
    started = time.monotonic()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if after:
        after()
    row = (step, int(seen.get["n"]), len(df.columns), time.monotonic() - started,
           json.dumps(settings, default=str, sort_keys=True))
    return df.sparkSession.createDataFrame(
        [row], "step string, num_samples long, num_columns int, elapsed_sec double, settings string"
    )


def read_block(
    spark: SparkSession, path: str, order: str | None = None, vector: str = "features", parts: Sequence[str] | None = None
) -> Block:
    """Load the newest version of a block, part by part if it was written so, and check that it has what a block needs.

    ``parts`` picks some of the parts. Parts of different names or dimensions can't be read as one block.
    """
    root = path.rstrip("/")
    versions = finished_versions(spark, root)
    if not versions:
        missing = "data" if not children(spark, f"{root}/data") else "a finished description"
        raise FileNotFoundError(f"no feature block at {root}: {missing} is missing")
    folders = [f"{root}/meta/version={n}" for n in versions]
    meta = spark.read.schema(META_SCHEMA + ", version int").option("basePath", f"{root}/meta").parquet(*folders)
    newest = Window.partitionBy("part")
    rows = meta.withColumn("_newest", F.max("version").over(newest)).where("version = _newest").orderBy("part", "position").collect()
    whole = max((r["version"] for r in rows if r["part"] is None), default=None)
    chosen = {r["part"]: r["version"] for r in rows if (r["part"] is None) == (whole is not None) and (parts is None or r["part"] in parts)}
    absent = sorted(set(parts or ()).difference(chosen))
    if absent or not rows:
        raise FileNotFoundError(f"no feature block at {root} for {absent}" if rows else f"feature block at {root} has no feature names")
    first = {part: next(r for r in rows if r["part"] == part) for part in chosen}
    names = {(first[part]["block"], *(r["name"] for r in rows if r["part"] == part)) for part in chosen}
    if len(names) > 1:
        raise ValueError(f"the parts {sorted(chosen)} of the block at {root} have different names: read them one by one")
    (name, *features), schema = names.pop(), StructType.fromJson(json.loads(next(iter(first.values()))["columns"]))
    if whole is not None:
        return Block(name, spark.read.schema(schema).parquet(f"{root}/data/version={whole}"), features, order, vector)
    found = [f"{root}/data/version={n}/{folder}" for part, n in chosen.items() for folder in part_folders(spark, f"{root}/data/version={n}", part)]
    if not found:  # parts without rows have no folder
        return Block(name, spark.createDataFrame([], schema), features, order, vector)
    df = spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*found).select(*schema.names)
    return Block(name, df, features, order, vector)


def part_folders(spark: SparkSession, folder: str, part: str) -> list[str]:
    return [name for name in children(spark, folder) if name.split("=", 1)[1:] == [part]]


def drop_old_versions(spark: SparkSession, path: str) -> list[int]:
    """Delete the versions that no reader needs any more: those whose every part has a newer one. The description goes
    first, so that a version half deleted is not read."""
    root = path.rstrip("/")
    finished = finished_versions(spark, root)
    covers: dict[int, set] = {}
    for n in finished:
        rows = spark.read.schema(META_SCHEMA).parquet(f"{root}/meta/version={n}").select("part").distinct().collect()
        covers[n] = {r["part"] for r in rows}
    old = [n for n in finished if covers[n] <= set().union(*(covers[m] for m in finished if m > n))]
    for n in old:
        for folder in (f"{root}/meta/version={n}", f"{root}/data/version={n}"):
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return old


def save_bucketed(block: Block, table: str, path: str, buckets: int) -> Block:
    """Store a block as a table bucketed and sorted by id, and return it as read back.

    Blocks with the same number of buckets are merged without moving a row: the one shuffle per block that a merge
    needs is paid here, once, however often the block is merged afterwards. A block whose ids are unique within a split
    is partitioned by the split as well.
    """
    writer = block.df.repartition(buckets, block.id_col).write.mode("overwrite").option("path", path)
    if block.within:
        writer = writer.partitionBy(*block.within)
    writer.bucketBy(buckets, block.id_col).sortBy(block.id_col).saveAsTable(table)
    return replace(block, df=block.df.sparkSession.table(table))


def replace_parts(block: Block, table: str, buckets: int) -> Block:
    """Write the parts (splits, say) that ``block`` has anew; the other parts of the bucketed table stay."""
    spark = block.df.sparkSession
    rows = block.df.select(*spark.table(table).columns).repartition(buckets, block.id_col)
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):  # a writer's option doesn't reach a table
        rows.write.insertInto(table, overwrite=True)
    return replace(block, df=spark.table(table))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists: a block may go by an alternate name."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"missing feature block: {list(paths)}")
