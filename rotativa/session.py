"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Below this many bytes per core a table does not fill the cores by its own row groups.
ROW_GROUP_BYTES = 128 << 20


def local_session(cores: int | str = "*", app: str = "rotativa", **extra: str) -> SparkSession:
    """A session for tests and single-machine use; on a cluster take the one the cluster gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = SETTINGS | {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Recording a Python call site for every column function takes longer than planning does.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Run once, keep in the shared folder and read from there as often as needed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: ModuleType) -> None:
    """Give Python workers the packages a model hook needs, once per application, where they are not installed."""
    for package in packages:
        key = (spark.sparkContext.applicationId, package.__name__)
        if key not in _shipped:
            folder = Path(package.__file__).resolve().parent
            target = f"{tempfile.mkdtemp(prefix='spark-')}/{package.__name__}"
            spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", folder.parent, folder.name))
            _shipped.add(key)


def input_bytes(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read Parquet. A table too small to fill the cores by its row groups is dealt out over them.

    Round robin, so that copies and hot keys do not meet in one task. Big tables are read as they lie: their row
    groups already outnumber the cores, and moving every text once more would cost more than it brings.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if input_bytes(spark, path) < cores * ROW_GROUP_BYTES:
        df = df.repartition(cores)
    return df
