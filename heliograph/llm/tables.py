"""Shared by the operators: reading tables, whole texts, word pattern, files on shared storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources import storage

# White space as the contracts of this package name it: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = "[ \\x09-\\x0D]+"


_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application; tasks import them by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = f"{tempfile.mkdtemp()}/{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(_PACKAGE.rglob("*.py")):
            packed.write(source, str(source.relative_to(_PACKAGE.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, and the name of that column.

    Where no id is null or comes twice, which one pass over the ids alone tells, the id is the number. Only other
    tables are written once with numbers.
    """
    name, number = free_name(docs, "_row_key"), F.col(id_column).cast("long")
    if docs.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long"):
        ids = docs.select(number.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        if ids.filter("id IS NULL OR n > 1").isEmpty():
            return docs.withColumn(name, number), name
    return storage.checkpoint(docs.withColumn(name, F.monotonically_increasing_id())), name


def without_rows(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``with_row_key`` but those whose number is in ``dropped``, a column of that name; with their own columns."""
    return keyed.join(dropped.select(F.col(key)), key, "left_anti").drop(key)


def whole_text(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, on the storage that driver and executors share, with its file system."""
    return qualified(spark, f"{storage.shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark takes it for: the cluster's default one where it names none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a :func:`qualified` folder and the path in it, for use inside tasks.

    Spark's own readers and writers have no binary record format with an index, so tasks write
    those files through Arrow's file systems (mounted paths, hdfs, s3, gs).
    """
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").removeprefix("//")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(uri)
