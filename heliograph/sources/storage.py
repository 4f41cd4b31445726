"""Fact tables on shared storage: batches, retention, inventory, export."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import clocks

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}  # by application, for local sessions that name none


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint directory.

    A local session without one gets a temporary folder; a cluster must name one.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured is None:
        configured = spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local_dirs:
            _local_dirs[application] = tempfile.mkdtemp(prefix="heliograph-")
        configured = _local_dirs[application]
    return configured.rstrip("/")


_scopes: list[str] = []


def _tables_dir(spark: SparkSession) -> str:
    return "/".join([f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}", *_scopes])


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that :func:`checkpoint` writes inside belong to ``name``, and those of its last use are removed first.

    For steps that follow each other and read only what the step before has written out: each holds its own tables
    until the next one begins.
    """
    _scopes.append(name)
    try:
        release(spark)
        yield
    finally:
        _scopes.pop()


# A write's shuffles are of no use once it has ended; otherwise their files stay until the driver collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Off in the session of a stream with state, where a hint to rebalance is then ignored and each task writes a file a day.
_ADAPTIVE = "spark.sql.adaptive.enabled"
# Most columns are hex ids, which only a codec that codes letters by frequency makes smaller.
_CODEC = "zstd"


# Generated methods of more bytes than this are never compiled by the JVM. A wide row's method is; without it, Spark
# generates one for each expression.
_METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def _set(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def compiled(spark: SparkSession):
    """What is executed inside runs as compiled code, however wide its rows are."""
    return _set(spark, _METHOD_LIMIT)


def without_shuffles(spark: SparkSession):
    """What is executed inside leaves no shuffle files behind."""
    return _set(spark, {_CLEAN_UP: "true"})


# How tables are written.
WRITTEN = {"compression": _CODEC}


def write_alone(spark: SparkSession, path: str, parts: Iterator[DataFrame], options: Callable[[list[str]], dict[str, str]]) -> None:
    """Write a table part by part, its rows as compiled code; of what the parts needed nothing stays on disk.

    ``options`` gives writer options by column names.
    """
    with _scratch(spark), compiled(spark), without_shuffles(spark):
        mode = "overwrite"
        for rows in parts:
            rows.write.mode(mode).options(**WRITTEN, **options(rows.columns)).parquet(path)
            mode = "append"


def _written(df: DataFrame, folder: str) -> DataFrame:
    spark, path = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.options(**WRITTEN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage; lost executors reread it from shared storage.

    A written table instead of an RDD checkpoint: it is read by column, and its size is known to
    the optimizer when it picks joins. :func:`release` removes them.
    """
    return _written(df, _tables_dir(df.sparkSession))


def checkpoint_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`checkpoint` of what ``make`` returns; the tables that it wrote on the way are removed."""
    folder = _tables_dir(spark)
    with _scratch(spark):
        return _written(make(), folder)


@contextmanager
def _scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`checkpoint` writes inside are removed at its end."""
    _scopes.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        folder = _tables_dir(spark)
        _scopes.pop()
        remove(spark, folder)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, worked out once, for as long as the block runs.

    A written table instead of a cache: rows that don't fit the memory would be cached on disk as they are in memory,
    several times as large. A batch may be evaluated only once, as it may come from a stream's state.
    """
    # A folder of its own and no scope, as sinks of several streams run beside each other.
    folder = f"{_tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    try:
        yield _written(df, folder)
    finally:
        remove(df.sparkSession, folder)


def _batch_dir(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


LOOKUP_KEYS = ("trace_id", "metric_name")

# Partition column per grain: days for busy tables, months where a day holds too little for a file.
GRAINS = {"day": "event_date", "month": "event_month"}


# Ids that lookups and resends ask for. Their columns get Bloom filters, by which readers skip row groups.
ID_COLUMNS = ("trace_id", "span_id")
FALSE_POSITIVES = 1e-5
_FILTER_BYTES = 8 << 20
_FILTER_SIZES = 11  # that are tried, each half as large as the one before; the smallest has 8 kB, for small files


def id_filters(columns: list[str]) -> dict[str, str]:
    """Writer options for a Bloom filter on each id column, as large as a row group's distinct ids need."""
    ids = [c for c in ID_COLUMNS if c in columns]
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ids}
    options |= {f"parquet.bloom.filter.fpp#{c}": str(FALSE_POSITIVES) for c in ids}
    options |= {f"parquet.bloom.filter.candidates.number#{c}": str(_FILTER_SIZES) for c in ids}
    sized = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(_FILTER_BYTES)}
    return options | sized if ids else {}


# Lists of this length reach the Parquet reader as equalities; longer ones only as their least and greatest value.
_PUSHED = 10


def among(column: str, ids: list[str]) -> Column:
    """Whether a column holds one of the ids, in a form that row groups' Bloom filters can answer.

    A balanced tree of short lists: a flat list is pushed down as a range, a chain of equalities is too deep.
    """
    parts = [F.col(column).isin(ids[i : i + _PUSHED]) for i in range(0, len(ids), _PUSHED)] or [F.lit(False)]
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _write(rows: DataFrame, folder: str, column: str | None) -> None:
    """Rows rebalanced by partition, sorted by the key that lookups use, with Bloom filters on ids."""
    with _set(rows.sparkSession, {_CLEAN_UP: "true", _ADAPTIVE: "true"}):  # read as the hint is given
        balanced = rows.hint("rebalance", column) if column else rows.hint("rebalance")
        lookup = next((c for c in LOOKUP_KEYS if c in rows.columns), None)
        if column and lookup:
            balanced = balanced.sortWithinPartitions(column, lookup)
        writer = balanced.write.mode("overwrite").options(**WRITTEN, **id_filters(rows.columns))
        (writer.partitionBy(column) if column else writer).parquet(folder)


def append_batch(df: DataFrame, path: str, batch_id: int, grain: str = "day") -> None:
    """Land one batch of facts by day or month, all or nothing.

    A batch owns its folder: a replay replaces it, and readers skip it until the job's commit
    marker is there. Rows are rebalanced by partition: a small one is written by one task as one
    file, and one that holds much of the batch is split over several. Files are sorted by the key
    that lookups use and have Bloom filters on ids, so that a search for one trace, span or metric skips
    most row groups.
    """
    column = GRAINS[grain]
    if grain == "month":
        df = df.withColumn(column, F.trunc("event_date", "month"))
    _write(df, _batch_dir(path, batch_id), column)


def _filesystem(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of finished writes by the number of their batch."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/_SUCCESS")
    found = [s.getPath().getParent() for s in (_filesystem(spark, path).globStatus(pattern) or [])]
    numbered = ((folder.getName().partition("=")[2], folder.toString()) for folder in found)
    # Batches of several writers are named, not numbered; those are not compacted.
    return {(int(name) if name.isdigit() else name): folder for name, folder in numbered}


@dataclass(frozen=True)
class _Layout:
    """What readers of a table open."""

    last: int  # newest batch that is rolled in, -1 without any
    rolled: dict[str, str]  # compacted folders: newest by partition, or one under ""
    superseded: list[str]  # older ones, which nobody reads any more
    tail: dict[int | str, str]  # batches after ``last``


def _layout(spark: SparkSession, path: str) -> _Layout:
    versions = _finished(spark, f"{path}/compacted")
    last = max(versions, default=-1)
    everything = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/compacted/batch_id=*/*=*")
    partitions = [s.getPath() for s in (_filesystem(spark, path).globStatus(everything) or [])] if versions else []
    version_of = {folder: number for number, folder in versions.items()}
    found = [(version_of[p.getParent().toString()], p.getName(), p.toString()) for p in partitions if p.getParent().toString() in version_of]
    rolled = {name: folder for _, name, folder in sorted(found)}
    superseded = [folder for _, name, folder in found if rolled[name] != folder]
    if versions and not rolled:
        rolled = {"": versions[last]}
    superseded += [folder for folder in versions.values() if folder != versions[last] and not any(f.startswith(f"{folder}/") for f in rolled.values())]
    tail = {n: folder for n, folder in _finished(spark, path).items() if not isinstance(n, int) or n > last}
    return _Layout(last, rolled, superseded, {n: tail[n] for n in sorted(tail, key=lambda n: (isinstance(n, str), n))})


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches that hold something to read, compacted ones first."""
    layout = _layout(spark, path)
    versions = (folder.rpartition("/")[0] if name else folder for name, folder in layout.rolled.items())
    return [*dict.fromkeys(versions), *layout.tail.values()]


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest batch, -1 where none has landed."""
    layout = _layout(spark, path)
    return max((n for n in layout.tail if isinstance(n, int)), default=layout.last)


def _read(spark: SparkSession, path: str, rolled: list[str], batches: list[str], schema: str | None = None) -> DataFrame | None:
    read = []
    for base, folders in ((f"{path}/compacted", rolled), (path, batches)):
        if folders:
            reader = spark.read.option("basePath", base)
            read.append((reader.schema(schema) if schema else reader).parquet(*folders))
    return reduce(DataFrame.unionByName, read) if read else None


def read_facts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All committed batches; a filter on ``event_date`` prunes folders."""
    layout = _layout(spark, path)
    rows = _read(spark, path, list(layout.rolled.values()), list(layout.tail.values()), schema)
    if rows is None and schema is None:
        raise FileNotFoundError(f"no committed batch under {path}")
    return spark.createDataFrame([], schema) if rows is None else rows


def compact(
    spark: SparkSession,
    path: str,
    grain: str | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    upto: int | None = None,
) -> int | None:
    """Roll batch folders together, so that readers open a few files instead of one folder per batch.

    Of a table by day or month only the partitions that the batches touch are rewritten, as new versions under
    the number of the last batch; the others stay in the version that they are in, and readers take the newest
    of each. Versions count once their marker is there, so a crash at any point leaves either the old state or the
    new one, and doing it again is harmless. (Overwriting partitions in place would replace them one after the
    other, with rows read twice or not at all between.) Without ``upto`` the newest batch stays out, as a stream that
    is restarted may write it again. Rows may be merged on the way (counts added up, first and last sight taken).
    What is superseded is removed at the end; call it from one process while no reader holds the old paths.
    Returns the last batch that was rolled in.
    """
    fs, make = _filesystem(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    layout = _layout(spark, path)
    numbers = sorted(n for n in layout.tail if isinstance(n, int))
    until = upto if upto is not None else (numbers[-2] if len(numbers) > 1 else None)
    chosen = [n for n in numbers if until is not None and n <= until]
    if not chosen:
        return None
    target, column = f"{path}/compacted/batch_id={chosen[-1]}", GRAINS[grain] if grain else None
    if column:
        patterns = [make(f"{layout.tail[n]}/{column}=*") for n in chosen]
        parts = [s.getPath() for p in patterns for s in (fs.globStatus(p) or [])]
        touched = {p.getName() for p in parts}
        new, old = [p.toString() for p in parts], [f for name, f in layout.rolled.items() if name in touched]
    else:
        new, old = [layout.tail[n] for n in chosen], list(layout.rolled.values())
    rows = _read(spark, path, old, new)
    if rows is not None:
        rows = rows.drop("batch_id")
        _write(merge(rows) if merge else rows, target, column)
    else:  # the batches were empty
        fs.create(make(f"{target}/_SUCCESS")).close()
    for number, folder in _finished(spark, path).items():
        if isinstance(number, int) and number <= chosen[-1]:
            fs.delete(make(folder), True)
    for folder in _layout(spark, path).superseded:
        fs.delete(make(folder), True)
    return chosen[-1]


def retain(df: DataFrame, keep_ns: int, time_column: str = "time_ns") -> DataFrame:
    """Facts no older than the horizon, counted back from the newest fact."""
    newest = df.agg(F.max(time_column)).scalar()
    return df.filter(F.col(time_column) >= newest - F.lit(keep_ns))


def retain_by_clock(df: DataFrame, now: str | int, keep_ns: int, time_column: str = "time_ns") -> DataFrame:
    """The same against a given clock; the literal bound also prunes days."""
    oldest = clocks.parse_bound(now) - keep_ns
    kept = df.filter(F.col(time_column) >= oldest)
    return kept.filter(F.col("event_date") >= clocks.event_date(F.lit(oldest).cast("bigint")))


def drop_expired(spark: SparkSession, path: str, now: str, keep_days: int, grain: str = "day") -> list[str]:
    """Remove the partitions of a table that end ``keep_days`` or more before ``now`` (a date); returns them.

    Only folders are listed and deleted, no row is read. A day or month that reaches into the kept time
    stays whole.
    """
    horizon = date.fromisoformat(now) - timedelta(days=keep_days)
    jvm = spark.sparkContext._jvm
    fs, dropped = _filesystem(spark, path), []
    patterns = [f"{base}/batch_id=*/{GRAINS[grain]}=*" for base in (path, f"{path}/compacted")]
    for status in [s for p in patterns for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(p)) or [])]:
        value = status.getPath().getName().partition("=")[2]
        if not value[:4].isdigit():
            continue
        first = date.fromisoformat(value)
        after = first + timedelta(days=1) if grain == "day" else (first + timedelta(days=31)).replace(day=1)
        if after <= horizon and fs.delete(status.getPath(), True):
            dropped.append(status.getPath().toString())
    return dropped


def release(spark: SparkSession) -> None:
    """Remove what :func:`checkpoint` has written in this application (inside :func:`scope`: in that scope); its
    results can't be read after that."""
    remove(spark, _tables_dir(spark))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it."""
    _filesystem(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def partition_inventory(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Rows, files and bytes per partition of a stored table, and its age in days behind the newest one.

    Rows are counted from the files' footers, sizes come with the file listing: no column is read.
    """
    files = df.groupBy(column, F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.max("_metadata.file_size").alias("size")
    )
    days = files.groupBy(column).agg(
        F.sum("n").alias("row_count"), F.count("*").alias("file_count"), F.sum("size").alias("total_bytes")
    )
    newest = days.agg(F.max(column)).scalar()
    return days.withColumn("age_days", F.date_diff(newest, column))


def inventory_summary(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Partition count, total rows and bytes, oldest partition and its age."""
    return partition_inventory(df, column).agg(
        F.count("*").alias("partition_count"),
        F.sum("row_count").alias("row_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.min(column).cast("string").alias("oldest_partition"),
        F.max("age_days").alias("oldest_age_days"),
    )


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def export(df: DataFrame, path: str, file_format: str = "json") -> None:
    """Write a result set as JSON lines, CSV or Parquet files, in parallel."""
    if file_format not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown export format {file_format!r}")
    writer = df.write.mode("errorifexists")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)
