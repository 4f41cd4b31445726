"""Tail sampling on a stream.

Spans are landed as they come. A second query counts, per trace and second, the few flags that decide about a
trace, and passes them on once the watermark has passed that second. There, each trace has a state of its own: its
first second sets a timer for the end of its wait, and when the watermark reaches it, the decision leaves the stream
and the flags go. A marker stays for ``remember`` seconds, in which nothing that still comes of the trace is heard; a
trace that returns after that is new. Flags are combined before the shuffle and there is one row for a trace's second,
so a trace of any length costs its task a few numbers.

Kept spans are copied from the landed ones by :func:`land_kept`, late ones included. State is in RocksDB, so it may
outgrow memory.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from heliograph.functions import clocks
from heliograph.operators import sampling
from heliograph.sources import storage
from heliograph.streaming.ingest import MAX_IDS, Stream, append_to, start

REMEMBER_SECONDS = 300
_FLAGS = list(sampling.FLAGS)
_STATE = "until bigint, decided boolean, span_count bigint, " + ", ".join(f"{f} boolean" for f in _FLAGS)
_DECIDED = "trace_id string, first_second bigint, span_count bigint, " + ", ".join(f"{f} boolean" for f in _FLAGS)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CODEC = "spark.sql.streaming.stateStore.rocksdb.compression"
_PREALLOCATED = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
_BLOCK = "spark.sql.streaming.stateStore.rocksdb.blockSizeKB"
_UPKEEP = "spark.sql.streaming.stateStore.maintenanceInterval"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged() -> list:
    return [F.sum("span_count").alias("span_count"), *[F.bool_or(f).alias(f) for f in _FLAGS]]


def trace_flags(spans: DataFrame, policy: sampling.Policy, lateness: str = "10 seconds") -> DataFrame:
    """Flags of each trace and second, for spans at most ``lateness`` behind the newest."""
    timed = spans.select(
        "trace_id",
        clocks.to_timestamp(F.col("start_ns")).alias("event_ts"),
        F.lit(1).cast("bigint").alias("span_count"),
        *sampling.span_flags(spans, policy),
    )
    seconds = timed.withWatermark("event_ts", lateness).groupBy("trace_id", F.window("event_ts", "1 second"))
    return seconds.agg(*_merged()).select(
        "trace_id", "window", F.unix_seconds("window.start").alias("second"), "span_count", *_FLAGS
    )


def _waiting(wait: int, remember: int) -> StatefulProcessor:
    """What is kept of one trace from its first second to its decision, and for a while after it.

    A trace that is heard when its wait and its marker's time are over already, as in a batch that spans more than
    that, is decided at once: each use of a state or timer is a call to the JVM, so those are left to traces that wait.
    """
    decision = Row("trace_id", "first_second", "span_count", *_FLAGS)

    class Waiting(StatefulProcessor):
        def init(self, handle) -> None:
            self._handle = handle
            self._trace = handle.getValueState("trace", _STATE)

        def handleInputRows(self, key, rows, timerValues):
            known = self._trace.get()
            if known and known[1]:
                return iter(())
            until, heard = known[0] if known else None, {}
            for row in rows:  # in any order; of the seconds, only those of the wait are held
                if until is None or (not known and row.second + wait < until):
                    until = row.second + wait
                    heard = {second: other for second, other in heard.items() if second < until}
                if row.second < until:
                    heard[row.second] = row
            if not known and timerValues.getCurrentWatermarkInMs() > (until + remember) * 1000:
                # Its timers would all run at the end of this batch and leave no state.
                flags = [any(row[name] for row in heard.values()) for name in _FLAGS]
                return iter([decision(key[0], until - wait, sum(row.span_count for row in heard.values()), *flags)])
            if not known:
                self._handle.registerTimer(until * 1000)
            spans, *flags = known[2:] if known else (0, *[False] * len(_FLAGS))
            spans += sum(row.span_count for row in heard.values())
            flags = [flag or any(row[name] for row in heard.values()) for flag, name in zip(flags, _FLAGS)]
            self._trace.update((until, False, spans, *flags))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            until, decided, spans, *flags = self._trace.get()
            if decided or timerValues.getCurrentWatermarkInMs() >= (until + remember) * 1000:
                self._trace.clear()
            else:
                self._trace.update((until, True, 0, *[False] * len(_FLAGS)))
                self._handle.registerTimer((until + remember) * 1000)
            if not decided:
                yield decision(key[0], until - wait, spans, *flags)

        def close(self) -> None:
            pass

    return Waiting()


def decisions(
    flags: DataFrame,
    policy: sampling.Policy,
    wait_seconds: int = sampling.DECISION_WAIT_SECONDS,
    remember_seconds: int = REMEMBER_SECONDS,
) -> DataFrame:
    """One row per trace as its wait ends, from the flags of its wait alone. A stream; ``flags`` as of :func:`trace_flags`."""
    waiting = _waiting(wait_seconds, remember_seconds)
    decided = flags.groupBy("trace_id").transformWithState(waiting, _DECIDED, outputMode="append", timeMode="eventTime")
    return decided.withColumn("is_kept", sampling.decide(policy))


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need, in a codec that makes hex ids smaller.

    Space is not allocated beforehand, which is megabytes for each version of each partition's stores, whatever they hold.
    A larger block holds ids that are alike, and the copies that a query stopped before this one had go sooner.
    """
    wanted = {_PROVIDER: _ROCKSDB, _CODEC: "zstd", _PREALLOCATED: "false", _BLOCK: "32", _UPKEEP: "10s"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def land_decisions(decided: DataFrame, table: str, options: Stream) -> StreamingQuery:
    """Land each micro-batch's decisions by the day on which the trace began. Read them with ``storage.read_facts``."""
    day = clocks.event_date(F.col("first_second") * clocks.NANOS_PER_SECOND)
    with state_on_disk(decided.sparkSession):
        return start(decided.withColumn("event_date", day), append_to(table, options.grain), options)


def land_kept(spark: SparkSession, spans: str, decided: str, kept: str, grain: str = "day") -> int | None:
    """Copy the spans of kept traces that are not there yet; call it whenever spans or decisions have landed.

    A run takes all landed spans of the traces decided since the run before, and the spans landed since then of traces
    decided earlier. How far it reaches is written down first, so a run that is repeated copies the same spans to the
    same folder. A trace that was forgotten and kept once more is not copied again. Returns the run's number, or
    None where nothing is new.
    """
    run = storage.last_batch(spark, kept) + 1
    reach = f"{kept}-reach"
    if storage.last_batch(spark, reach) < run:
        landed_to = storage.last_batch(spark, spans), storage.last_batch(spark, decided)
        if min(landed_to) < 0 or landed_to == _reach(spark, reach, run - 1):
            return None
        planned = spark.createDataFrame([landed_to], "spans int, decided int")
        planned.coalesce(1).write.mode("overwrite").parquet(f"{reach}/batch_id={run}")
    (spans_from, decided_from), (spans_to, decided_to) = (_reach(spark, reach, n) for n in (run - 1, run))
    landed = storage.read_facts(spark, spans).filter(F.col("batch_id") <= spans_to)
    verdicts = storage.read_facts(spark, decided, f"{_DECIDED}, is_kept boolean, event_date date, batch_id int").filter((F.col("batch_id") <= decided_to) & F.col("is_kept"))
    earlier = verdicts.filter(F.col("batch_id") <= decided_from).select("trace_id")
    fresh = storage.checkpoint(verdicts.filter(F.col("batch_id") > decided_from).select("trace_id", "event_date").distinct())
    ids = [r[0] for r in fresh.select("trace_id").limit(MAX_IDS + 1).collect()]
    first_day = fresh.agg(F.min("event_date")).first()[0]
    again, older = earlier, landed.filter(F.col("event_date") >= F.lit(first_day))
    if len(ids) <= MAX_IDS:  # few traces: look them up by the id filters of both tables
        again, older = again.filter(storage.among("trace_id", ids)), older.filter(storage.among("trace_id", ids))
    fresh = storage.checkpoint(fresh.select("trace_id").distinct().join(again, "trace_id", "left_anti"))
    late = landed.filter(F.col("batch_id") > spans_from).join(storage.checkpoint(earlier.distinct()), "trace_id", "left_semi")
    rows = older.join(fresh, "trace_id", "left_semi").unionByName(late)
    internal = ["batch_id", *(["event_month"] if "event_month" in landed.columns else [])]
    storage.append_batch(rows.drop(*internal), kept, run, grain)
    return run


def compact_landed(spark: SparkSession, spans: str, decided: str, kept: str, grain: str = "day") -> None:
    """Roll together the batches of spans and decisions that the last run of :func:`land_kept` has taken in.

    Later ones must stay apart: a run tells by their numbers what is new.
    """
    for table, upto in zip((spans, decided), _reach(spark, f"{kept}-reach", storage.last_batch(spark, kept))):
        storage.compact(spark, table, grain, upto=upto)


def _reach(spark: SparkSession, path: str, run: int) -> tuple[int, int]:
    if run < 0:
        return -1, -1
    return tuple(spark.read.schema("spans int, decided int").parquet(f"{path}/batch_id={run}").first())
