"""Continuous ingest: landed export requests to fact tables and what is kept up to date with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from heliograph.operators import dimensions, metrics, spanmetrics
from heliograph.operators.sides import bounded
from heliograph.sources import envelopes, storage

# Export requests repeat their field names and resources, so landed text shrinks to a tenth. Readers tell by the file name.
LANDED = {"compression": "gzip"}

# Micro-batch pace of the collector pipelines: seconds between batches, and items (or files) taken per batch.
PACES = {"agent": (1, 1024), "gateway": (5, 256), "browser": (1, 100)}

Sink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Stream:
    """A running job's options. ``once`` drains what has landed and stops; ``cut``: see :func:`read_landing`."""

    checkpoint: str
    once: bool = True
    pace: str = "gateway"
    grain: str = "day"
    cut: bool = False


def land(requests: DataFrame, signal: str, path: str, pace: str = "gateway") -> None:
    """Land parsed requests in files of at most a pace's items, however many a request holds.

    Items, not requests, are dealt into files, so one large request becomes several files and nothing has to be put
    in one place to be counted.
    """
    items = envelopes.single_items(requests, signal)
    items.write.mode("append").options(**LANDED, maxRecordsPerFile=PACES[pace][1]).text(path)


def read_landing(spark: SparkSession, signal: str, path: str, pace: str = "gateway", cut: bool = False) -> DataFrame:
    """Export requests as they land, at most a pace's number of files per micro-batch.

    ``cut`` tells that files come from :func:`land`: then a micro-batch is one of them, at most the pace's items.
    """
    reader = spark.readStream.schema(envelopes.REQUEST_SCHEMAS[signal])
    return reader.option("maxFilesPerTrigger", 1 if cut else PACES[pace][1]).json(path)


def start(df: DataFrame, sink: Sink, options: Stream) -> StreamingQuery:
    """Feed every micro-batch of a stream to a sink."""
    return _trigger(df.writeStream.foreachBatch(sink), options)


def _trigger(writer: DataStreamWriter, options: Stream) -> StreamingQuery:
    writer = writer.option("checkpointLocation", options.checkpoint)
    if options.once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{PACES[options.pace][0]} seconds").start()


def ingest(spark: SparkSession, signal: str, landing: str, table: str, options: Stream) -> StreamingQuery:
    """Flatten landed requests and append them; nothing is late, an empty batch adds no rows.

    Each batch is rebalanced by its days and lands under its own id, visible as a whole and replaced
    by a replay. Read the table with ``storage.read_facts``.
    """
    facts = envelopes.FLATTEN[signal](read_landing(spark, signal, landing, options.pace, options.cut))
    return start(facts, append_to(table, options.grain), options)


def append_to(table: str, grain: str = "day") -> Sink:
    return lambda batch, batch_id: storage.append_batch(batch, table, batch_id, grain)


def keep_dimensions(root: str) -> Sink:
    """Land each batch's dimension rows under its batch id.

    Writers never update a shared row: replays replace their own folder, several writers add
    folders, and :func:`read_dimension` merges by min and max.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        with storage.kept(batch.select("service_name", "name", "kind", "resource", "start_ns")) as needed:
            for name, rows in dimensions.batch_dims(needed).items():
                rows.write.mode("overwrite").options(**storage.WRITTEN).parquet(f"{root}/{name}/batch_id={batch_id}")

    return sink


def compact_dimensions(spark: SparkSession, root: str) -> None:
    """Roll each dimension's batches into one merged folder."""
    for name, keys in dimensions.DIMENSIONS.items():
        storage.compact(spark, f"{root}/{name}", merge=lambda rows, keys=keys: dimensions.merge_dim(rows, rows.limit(0), keys))


def read_dimension(spark: SparkSession, root: str, name: str) -> DataFrame:
    rows = storage.read_facts(spark, f"{root}/{name}").drop("batch_id")
    return dimensions.merge_dim(rows, rows.limit(0), dimensions.DIMENSIONS[name])


def keep_volume(root: str, signal: str, sink: Sink | None = None) -> Sink:
    """Record how many rows each batch brought.

    Around another sink the rows are counted as that sink writes them, by a metric observed on the way; a batch is
    not read again for it. ``sink`` must begin by running the whole batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        counted = F.count(F.lit(1)).alias("row_count")
        if sink is None:
            rows = batch.agg(counted).first()[0]
        else:
            seen = Observation()
            sink(batch.observe(seen, counted), batch_id)
            try:
                rows = seen.get["row_count"]
            except Py4JJavaError:  # the sink's plan lost the metric, which happens to batches found empty as they run
                rows = batch.agg(counted).first()[0]
        row = batch.sparkSession.createDataFrame([(rows, signal)], "row_count bigint, signal string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{root}/batch_id={signal}-{batch_id}")

    return run


def read_volume(spark: SparkSession, root: str) -> DataFrame:
    """Batches, rows and the spread of batch sizes per signal; one row per batch goes in."""
    return (
        storage.read_facts(spark, root)
        .groupBy("signal")
        .agg(
            F.count("*").alias("batch_count"),
            F.sum("row_count").alias("row_count"),
            F.min("row_count").alias("smallest_batch"),
            F.percentile_approx("row_count", 0.5).alias("median_batch"),
            F.max("row_count").alias("largest_batch"),
        )
    )


def keep_span_metrics(table: str, every_ns: int = spanmetrics.FLUSH_NS) -> Sink:
    """Land each batch's counts per flush interval; they add up whatever order spans arrive in."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        deltas = spanmetrics.interval_deltas(batch, every_ns)
        with storage.without_shuffles(batch.sparkSession):
            deltas.write.mode("overwrite").options(**storage.WRITTEN).parquet(f"{table}/batch_id={batch_id}")

    return sink


def compact_span_metrics(spark: SparkSession, table: str) -> None:
    """Add up the batches' counts per series and flush interval in one folder."""
    storage.compact(spark, table, merge=spanmetrics.added)


def read_span_metrics(spark: SparkSession, table: str, expire_ns: int | None = None) -> DataFrame:
    return spanmetrics.cumulative(storage.read_facts(spark, table).drop("batch_id"), expire_ns)


def fan_out(*sinks: Sink) -> Sink:
    """Feed one batch to several sinks, read and flattened once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        with storage.kept(batch) as rows:
            for each in sinks:
                each(rows, batch_id)

    return sink


def guarded(table: str, names: str, limit: int = metrics.MAX_METRIC_NAMES, grain: str = "day") -> Sink:
    """Append points of admitted metric names only.

    A name once admitted stays; room left goes to new names by first sight. Each batch lands the
    names it admitted under its id, so a replay starts from the batches before it.
    """
    schema = "metric_name string"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = storage.read_facts(spark, names, schema + ", batch_id int").filter(F.col("batch_id") < batch_id)
        known = bounded(stored.select("metric_name").limit(limit), limit)
        room = limit - stored.count()
        fresh = metrics.admitted_names(batch.join(known, "metric_name", "left_anti"), max(room, 0))
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{names}/batch_id={batch_id}")
        admitted = storage.read_facts(spark, names, schema + ", batch_id int").select("metric_name").limit(limit)
        kept = batch.join(bounded(admitted, limit), "metric_name", "left_semi")
        storage.append_batch(kept, table, batch_id, grain)

    return sink


def tag_source(df: DataFrame, source: str = "browser") -> DataFrame:
    """Mark everything from one input in its resource."""
    return envelopes.tag_resource(df, "telemetry.source", source)


# A batch of at most so many spans asks for its ids one by one: the items of the largest pace.
MAX_IDS = max(items for _, items in PACES.values())


def landed_keys(stored: DataFrame, batch: DataFrame, key: list[str], most_ids: int = MAX_IDS) -> DataFrame:
    """Keys of stored spans that may be in the batch.

    A batch of at most ``most_ids`` spans, the bound of its pace, hands its ids to the scan. Row groups whose
    Bloom filters know none of them are not read, so what is read follows from the batch and its resends, not from
    how much has landed. A larger batch reads the keys of its days. ``batch`` must be materialised.
    """
    ids = batch.select("trace_id", "span_id").limit(most_ids + 1).collect()
    if len(ids) <= most_ids:
        for column, values in (("trace_id", {r[0] for r in ids}), ("span_id", {r[1] for r in ids})):
            stored = stored.filter(storage.among(column, sorted(values - {None})))
    return stored.select(key)


def keep_first(table: str, grain: str = "day", most_ids: int = MAX_IDS) -> Sink:
    """Append spans that have not landed before, however late they or their copies come.

    There is no state but the table: a batch collapses its own copies and leaves out those whose ids
    earlier batches landed on the same days (a copy has the times of its original). Only the folders of
    the batch's days are opened, and there :func:`landed_keys`. A replay sees the batches before it.
    """
    key = ["event_date", "trace_id", "span_id"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        with storage.kept(batch) as rows:
            days = [r[0] for r in rows.select("event_date").distinct().collect()]  # one row per day
            column = storage.GRAINS[grain]
            folders = {d.replace(day=1) for d in days} if grain == "month" else days
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            parts = "" if grain == "day" else f", {column} date"
            stored = storage.read_facts(batch.sparkSession, table, f"{schema}{parts}, batch_id int")
            earlier = stored.filter((F.col("batch_id") < batch_id) & F.col(column).isin(list(folders)))
            fresh = rows.dropDuplicates(key).join(landed_keys(earlier, rows, key, most_ids), key, "left_anti")
            storage.append_batch(fresh, table, batch_id, grain)

    return sink
