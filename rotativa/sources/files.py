"""Folders of files, and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEM = "stem"
FORMATS = ("csv", "json", "parquet")


def matching_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in (found or []))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_folder(
    spark: SparkSession, folder: str, pattern: str, schema: str | T.StructType | None = None, lines_in_values: bool = False
) -> DataFrame:
    """All matching files in one scan, with the stem of the file each row comes from.

    CSV values that hold line feeds need ``lines_in_values``, which takes a task per file whatever its size.
    """
    if not matching_files(spark, folder, pattern):
        raise FileNotFoundError(f"no files {pattern!r} in {folder}")
    kind = pattern.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"cannot read {pattern!r}; formats: {FORMATS}")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.options(header=True, multiLine=lines_in_values, escape='"')
    df = reader.load(f"{folder.rstrip('/')}/{pattern}")
    # The name comes percent-encoded, as in a URL, where a plus sign stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.withColumn(STEM, file_stem(name))


def convert_folder(
    spark: SparkSession, folder: str, pattern: str, out: str, schema: str | T.StructType | None = None,
    lines_in_values: bool = False,
) -> list[str]:
    """One Parquet dataset per file stem, written in one job; returns the paths there are, sorted."""
    read_folder(spark, folder, pattern, schema, lines_in_values).write.mode("overwrite").partitionBy(STEM).parquet(out)
    return matching_files(spark, out, f"{STEM}=*")


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header and no index. Arrays, maps and structs become JSON text.

    A row is one line, so that big files can be read by many tasks: line feeds, carriage returns and backslashes in
    strings are written as ``\\n``, ``\\r`` and ``\\\\``, U+0000, which CSV readers drop, as ``\\0``; null is written as
    ``\\N``, the empty string as ``""``.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat: Sequence[Column] = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested)
        else escaped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").options(
        header=True, encoding="UTF-8", escape='"', quoteAll=True, emptyValue="", nullValue=NULL, **KEEP_SPACES
    ).csv(path)


KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
NULL = r"\N"  # no escaped string reads like this


def escaped(c: Column) -> Column:
    for plain, mark in (("\\", r"\\"), ("\n", r"\n"), ("\r", r"\r"), ("\0", r"\0")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    """The text is cut at pairs of backslashes first, so that ``\\\\n`` stays a backslash and an n."""
    def plain(piece: Column) -> Column:
        for mark, character in ((r"\n", "\n"), (r"\r", "\r"), (r"\0", "\0")):
            piece = F.replace(piece, F.lit(mark), F.lit(character))
        return piece

    whole = F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")
    return F.when(F.contains(c, F.lit("\\")), whole).otherwise(c)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What ``export_csv`` wrote; files are split over tasks."""
    df = spark.read.schema(schema).options(header=True, escape='"', emptyValue="", nullValue=NULL, **KEEP_SPACES).csv(path)
    return df.select(*[
        unescaped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields
    ])
