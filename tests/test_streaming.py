"""Streams against the batch result over the same rows, fed in several micro-batches."""

import datetime
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from heliograph.functions import values
from heliograph.operators import dimensions, sampling, services, spanmetrics
from heliograph.operators.filters import TimeRange
from heliograph.sources import envelopes, storage
from heliograph.streaming import catalogue, correlation, counters, ingest, live
from heliograph.streaming import sampling as stream_sampling

SECOND = 10**9


def feed(spark, frames, sink, tmp_path):
    """One run of the stream per frame, on one checkpoint: each frame is its own micro-batch."""
    source = str(tmp_path / "in")
    schema = frames[0].schema
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.start(stream, sink, ingest.Stream(str(tmp_path / "checkpoint"))).awaitTermination()


def some_spans(make_spans):
    rows = [
        {"trace": f"t{i % 5}", "id": f"s{i}", "name": f"op{i % 3}", "service": f"svc{i % 2}", "status": i % 3,
         "start": i * SECOND, "end": i * SECOND + (i % 7) * 10**6}
        for i in range(60)
    ]
    return make_spans(rows)


def test_landing_to_facts(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "facts")
    landing.mkdir()
    options = ingest.Stream(str(tmp_path / "checkpoint"))

    def land(name, *ids):
        spans = [{"trace_id": "ab", "span_id": i, "start_time_unix_nano": "5"} for i in ids]
        request = {"resource_spans": [{"scope_spans": [{"spans": spans}]}]} if ids else {}
        (landing / name).write_text(json.dumps(request) + "\n")

    for name, ids in (("1.json", ["aa", "bb"]), ("2.json", []), ("3.json", ["cc"])):
        land(name, *ids)
        ingest.ingest(spark, "traces", str(landing), table, options).awaitTermination()
    assert sorted(r.span_id for r in storage.read_facts(spark, table).collect()) == ["aa", "bb", "cc"]


def test_dimensions_equal_batch_and_survive_replay(spark, make_spans, tmp_path):
    spans = some_spans(make_spans).withColumn("resource", F.create_map(F.lit("a"), values.any_value(string=F.col("service_name"))))
    sink = ingest.keep_dimensions(str(tmp_path / "dims"))
    late = spans.filter(f"start_ns < {20 * SECOND}")
    feed(spark, [spans.filter(f"start_ns >= {20 * SECOND}"), late], sink, tmp_path)
    sink(late, 1)  # the last batch once more
    for name, build in (("service", dimensions.service_dim), ("operation", dimensions.operation_dim), ("resource", dimensions.resource_dim)):
        want = build(spans)
        got = ingest.read_dimension(spark, str(tmp_path / "dims"), name).select(want.columns)
        assert sorted(got.collect()) == sorted(want.collect())


def test_span_metrics_equal_batch(spark, make_spans, tmp_path):
    spans = some_spans(make_spans)
    table = str(tmp_path / "calls")
    feed(spark, [spans.filter("start_ns % 2 = 0"), spans.filter("start_ns % 2 <> 0"), spans.limit(0)], ingest.keep_span_metrics(table), tmp_path)
    want = spanmetrics.cumulative(spanmetrics.interval_deltas(spans)).collect()
    assert sorted(map(str, ingest.read_span_metrics(spark, table).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("expire", [None, 40 * SECOND])
def test_counters_from_snapshots_equal_all_history(spark, make_spans, tmp_path, expire):
    """Batches in any order, with late counts that join two lives: every read equals the one over all counts."""
    rnd = random.Random(4)
    rows = [
        {"trace": f"t{i}", "id": f"s{i}", "name": f"op{i % 3}", "service": f"svc{i % 2}", "start": t * SECOND, "end": t * SECOND + i}
        for i, t in enumerate(sorted(rnd.choice([0, 300, 700]) + rnd.randrange(150) for _ in range(90)))
    ]
    order = [rows[40:], rows[:20], rows[20:40], rows[5:8]]
    table, apart, every = str(tmp_path / "calls"), 100 * SECOND, 5 * SECOND
    sink, everything = counters.keep_counters(table, expire, every, apart), None
    for number, part in enumerate(order):
        spans = make_spans(part)
        sink(spans, number)
        everything = spans if everything is None else everything.union(spans)
        if number == 2:
            sink(spans, number)  # a replay
            counters.compact(spark, table)
        whole = spanmetrics.cumulative(spanmetrics.interval_deltas(everything, every), expire).collect()
        for since in (0, 150, 400, 800, 2000):
            got = counters.read_since(spark, table, since * SECOND, expire, apart).collect()
            assert sorted(map(str, got)) == sorted(str(r) for r in whole if r.flush_ns >= since * SECOND)


def test_a_read_opens_the_last_snapshot_and_what_came_after(spark, make_spans, tmp_path, scanned_rows):
    day, read = 24 * 3600, []
    table = str(tmp_path / "calls")
    sink = counters.keep_counters(table, 60 * SECOND)
    for number in range(3):
        sink(make_spans([{"id": f"{number}-{i}", "start": (number * day + 60 * i) * SECOND} for i in range(400)]), number)
        read.append(sum(scanned_rows(counters.read_since(spark, table, (number * day + 3600) * SECOND, 60 * SECOND))))
    assert read == [400, 400, 400]


def test_sketches_merge_over_batches_and_days(spark, tmp_path):
    def points(lo, hi, day):
        label = F.create_map(F.lit("user"), values.any_value(string=F.col("id").cast("string")), F.lit("k"), values.any_value(string=(F.col("id") % 7).cast("string")))
        return spark.range(lo, hi).select(
            F.lit("m").alias("metric_name"), F.lit("svc").alias("service_name"), label.alias("attributes"),
            (F.lit(day * 86400 * SECOND) + F.col("id")).alias("time_ns"), F.date_add(F.lit("1970-01-01").cast("date"), day).alias("event_date"),
        )

    table = str(tmp_path / "sketches")
    batches = [points(0, 30_000, 3), points(20_000, 40_000, 4), points(0, 10_000, 3), points(0, 5, 9)]
    for number, batch in enumerate(batches):
        catalogue.keep_sketches(table)(batch, number)
    wanted = {"user": 40_000, "k": 7, None: 40_000}
    for compacted in (False, True):
        if compacted:
            catalogue.compact(spark, table)
            days = {r.event_date.day: r["count"] for r in storage.read_facts(spark, table).groupBy("event_date").count().collect()}
            assert days == {4: 3, 5: 3, 10: 3}
        got = {r.label: r for r in catalogue.cardinalities(spark, table).collect()}
        for label, exact in wanted.items():
            assert abs(got[label].distinct_values - exact) <= 3 * catalogue.ERROR * exact
            assert got[label].point_count == 60_005
    month = TimeRange(9 * 86400 * SECOND, 10 * 86400 * SECOND)
    assert {r.label: r.distinct_values for r in catalogue.cardinalities(spark, table, month).collect()} == {"user": 5, "k": 5, None: 5}


def test_logs_meet_their_span_as_either_comes(spark, tmp_path):
    """Logs before, with and after their span, one span with most of them, a resent span, and spans that come too late."""
    root, minute = str(tmp_path), 60
    log_schema = "trace_id string, span_id string, time_ns bigint, body_text string, arrived timestamp, event_date date"
    span_schema = "trace_id string, span_id string, name string, service_name string, arrived timestamp"

    def at(seconds):
        return datetime.datetime.fromtimestamp(10**9 + seconds)

    def logs(*rows):
        return spark.createDataFrame([("t", s, i, b, at(a), datetime.date(2001, 9, 9)) for i, (s, b, a) in enumerate(rows)], log_schema)

    def spans(*rows):
        return spark.createDataFrame([("t", s, f"op-{s}", "svc", at(a)) for s, a in rows], span_schema)

    waves = [
        (logs(("early", "e", 0), ("never", "n", 0), (None, "no id", 0), *[("hot", f"h{i}", 1) for i in range(50)]), spans(("old", 0))),
        (logs(("old", "o", 5 * minute)), spans(("early", 5 * minute), ("hot", 5 * minute), ("old", 5 * minute))),
        (logs(("hot", "after", 9 * minute), ("gone", "g", 9 * minute)), spans(("x", 9 * minute))),
        (logs(("y", "y", 100 * minute)), spans(("gone", 100 * minute), ("z", 100 * minute))),
        (logs(("y", "yy", 200 * minute)), spans(("z2", 200 * minute))),
    ]
    for wave in waves:
        for rows, name in zip(wave, ("logs", "spans")):
            rows.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(rows.schema).parquet(f"{root}/{name}") for rows, name in zip(wave, ("logs", "spans"))]
        sink = correlation.land_matches(f"{root}/matched", f"{root}/unmatched")
        joined = correlation.match_logs(*streams, wait="10 minutes", salts=3)
        correlation.start_matching(joined, sink, ingest.Stream(f"{root}/checkpoint")).awaitTermination()
    matched = storage.read_facts(spark, f"{root}/matched").collect()
    assert sorted(r.body_text for r in matched) == sorted(["e", "o", "after", *[f"h{i}" for i in range(50)]])
    assert all(r.span_name == f"op-{r.span_id}" for r in matched)
    assert sorted(r.body_text for r in storage.read_facts(spark, f"{root}/unmatched").collect()) == ["g", "n", "no id", "y"]
    settled = correlation.settle(spark, f"{root}/unmatched", spark.read.parquet(f"{root}/spans").dropDuplicates(["trace_id", "span_id"]))
    assert {r.body_text: r.span_name for r in settled.collect()} == {"g": "op-gone", "n": None, "no id": None, "y": None}


def live_sinks(tmp_path):
    spans, panes = str(tmp_path / "spans"), str(tmp_path / "panes")
    return spans, panes, ingest.fan_out(ingest.append_to(spans), live.keep_panes(panes))


def test_live_window_equals_batch(spark, make_spans, tmp_path):
    spans = some_spans(make_spans).withColumn("event_date", F.lit("1970-01-01").cast("date"))
    landed, panes, sink = live_sinks(tmp_path)
    feed(spark, [spans.filter(f"start_ns >= {30 * SECOND}"), spans.filter(f"start_ns < {30 * SECOND}")], sink, tmp_path)
    want = services.red(spans.filter(f"start_ns < {60 * SECOND}")).drop("last_seen")
    assert sorted(live.red_window(spark, panes, landed, 60 * SECOND, 30).collect()) == sorted(want.collect())
    live.compact_panes(spark, panes)
    storage.compact(spark, landed, "day")
    assert sorted(live.red_window(spark, panes, landed, 60 * SECOND, 30).collect()) == sorted(want.collect())
    assert live.red_window(spark, panes, landed, 3 * 3600 * SECOND, 30).count() == 0
    sink(spans, 2)  # everything once more, of which one table lacks a batch
    storage.append_batch(spans, landed, 3)
    want = services.red(spans.union(spans)).drop("last_seen")
    assert sorted(live.red_window(spark, panes, landed, 60 * SECOND, 30).collect()) == sorted(want.collect())


def test_panes_are_bounded_and_few_spans_are_read(spark, tmp_path):
    """A pane's rows follow from the spread of durations, not from the spans; the percentiles are exact."""
    def spans(n):
        duration = 10**9 + F.pmod(F.xxhash64("id"), F.lit(2 * 10**9))
        return spark.range(n).select(
            F.lit("hot").alias("service_name"), (F.col("id") % 3).cast("int").alias("status_code"), (F.col("id") % 50 * SECOND).alias("start_ns"),
            (F.col("id") % 50 * SECOND + duration).alias("end_ns"), F.lit("1970-01-01").cast("date").alias("event_date"),
        )

    rows = [live.panes(spans(n)).count() for n in (20_000, 80_000)]
    assert rows[0] == rows[1] < 60
    landed, panes, sink = live_sinks(tmp_path)
    sink(spans(20_000), 0)
    got = live.red_window(spark, panes, landed, 60 * SECOND, 30).first()
    want = spans(20_000).agg(*[F.round(F.percentile(F.col("end_ns") - F.col("start_ns"), q) / 1e6, 2) for q in (0.5, 0.95, 0.99)]).first()
    assert (got.p50_latency_ms, got.p95_latency_ms, got.p99_latency_ms) == tuple(want)


def test_guard_remembers_names_between_batches(spark, tmp_path):
    def points(*names):
        rows = [(n, i) for i, n in enumerate(names)]
        return spark.createDataFrame(rows, "metric_name string, time_ns bigint").withColumn("event_date", F.lit("2024-01-01").cast("date"))

    table, names = str(tmp_path / "points"), str(tmp_path / "names")
    sink = ingest.guarded(table, names, 3)
    feed(spark, [points("b", "a"), points("a", "c", "d"), points("d", "b", "e")], sink, tmp_path)
    sink(points("d", "b", "e"), 2)
    kept = sorted(r.metric_name for r in storage.read_facts(spark, table).collect())
    assert kept == ["a", "a", "b", "b", "c"]


def test_volume(spark, make_spans, tmp_path):
    spans = some_spans(make_spans)
    root = str(tmp_path / "volume")
    feed(spark, [spans, spans.limit(20)], ingest.keep_volume(root, "spans"), tmp_path)
    assert tuple(ingest.read_volume(spark, root).first()) == ("spans", 2, 80, 20, 20, 60)


def test_batches_are_cut_by_items(spark, tmp_path):
    """No batch holds more than the pace's items, whatever the requests hold; nothing is lost or changed."""
    def span(i):
        return {"traceId": f"{i % 9:032x}", "spanId": f"{i:016x}", "name": f"op{i}", "startTimeUnixNano": str(i), "attributes": [{"key": "n", "value": {"intValue": i}}]}

    groups, at = [], 0
    for size in (1, 250, 3, 0, 90, 6):
        groups.append({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": f"svc{size}"}}]},
                                          "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span(at + i) for i in range(size)]}]}]})
        at += size
    requests = spark.createDataFrame([(json.dumps(g),) for g in groups], "request string").repartition(2)
    landing, table, volume = (str(tmp_path / n) for n in ("landing", "facts", "volume"))
    ingest.land(envelopes.parse_requests(requests, "traces"), "traces", landing, "browser")
    options = ingest.Stream(str(tmp_path / "checkpoint"), pace="browser", cut=True)
    facts = envelopes.flatten_spans(ingest.read_landing(spark, "traces", landing, "browser", cut=True), 7)
    ingest.start(facts, ingest.keep_volume(volume, "spans", ingest.append_to(table)), options).awaitTermination()
    figures = ingest.read_volume(spark, volume).first()
    assert figures.row_count == at == 350 and figures.largest_batch == 100 and figures.batch_count >= 4
    whole = envelopes.flatten_spans(envelopes.parse_requests(requests, "traces"), 7)
    assert sorted(map(str, storage.read_facts(spark, table).select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_single_points_of_every_metric_type(spark):
    points = [{"timeUnixNano": "5", "asDouble": 1.5}, {"timeUnixNano": "6", "asInt": "3", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}]
    metrics = [{"name": "g", "unit": "1", "gauge": {"dataPoints": points}}, {"name": "s", "sum": {"dataPoints": points, "aggregationTemporality": 2, "isMonotonic": True}},
               {"name": "h", "histogram": {"data_points": [{"time_unix_nano": "7", "count": "3", "sum": 4.0, "bucket_counts": ["1", "2"], "explicit_bounds": [5.0]}]}}]
    request = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"scope": {"name": "lib"}, "metrics": metrics}]}]}
    parsed = envelopes.parse_requests(spark.createDataFrame([(json.dumps(request),)], "request string"), "metrics")
    single = envelopes.single_items(parsed, "metrics")
    assert single.count() == 5
    again = envelopes.flatten_metrics(envelopes.parse_requests(single, "metrics"), 1)
    assert sorted(map(str, again.collect())) == sorted(map(str, envelopes.flatten_metrics(parsed, 1).collect()))


def test_volume_is_observed_as_a_sink_writes(spark, make_spans, tmp_path):
    spans = some_spans(make_spans).withColumn("event_date", F.lit("1970-01-01").cast("date"))
    root, table = str(tmp_path / "volume"), str(tmp_path / "facts")
    sink = ingest.keep_volume(root, "spans", ingest.append_to(table))
    feed(spark, [spans, spans.limit(20), spans.limit(0)], sink, tmp_path)
    assert tuple(ingest.read_volume(spark, root).first())[:3] == ("spans", 3, 80)
    assert storage.read_facts(spark, table).count() == 80
    sink(spans.limit(7), 2)  # a replay of the last batch, now with rows
    assert tuple(ingest.read_volume(spark, root).first())[:3] == ("spans", 3, 87)


def test_dedup_drops_retries_and_loses_nothing_late(spark, make_spans, tmp_path):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("start_ns") / (20 * SECOND)).cast("int"))
    spans = some_spans(make_spans).select("trace_id", "span_id", "start_ns").withColumn("event_date", day)
    table = str(tmp_path / "spans")
    # Newest day first; then copies together with spans two days older; then everything again.
    sink = ingest.keep_first(table)
    feed(spark, [spans.filter(f"start_ns >= {40 * SECOND}"), spans.union(spans), spans], sink, tmp_path)
    sink(spans, 2)  # a replay
    landed = storage.read_facts(spark, table)
    assert landed.count() == 60 and landed.select("span_id").distinct().count() == 60
    assert {r.batch_id: r["count"] for r in landed.groupBy("batch_id").count().collect()} == {0: 20, 1: 40}


def test_dedup_reads_what_the_batch_may_hold(spark, tmp_path, scanned_rows):
    """Rows read for a batch do not grow with what has landed on its day, one trace with all spans included."""
    key = ["event_date", "trace_id", "span_id"]

    def part(lo, hi):
        trace = F.md5((F.col("id") % 2).cast("string")).alias("trace_id")
        span = F.md5(F.col("id").cast("string")).alias("span_id")
        return spark.range(lo, hi).select(trace, span, F.lit("2024-01-01").cast("date").alias("event_date"))

    table = str(tmp_path / "spans")
    sink, read = ingest.keep_first(table), []
    for number in range(4):
        sink(part(number * 800, number * 800 + 800), number)
        stored = storage.read_facts(spark, table)
        probes = part(10**6, 10**6 + 900), part(790, 810)
        read.append([scanned_rows(ingest.landed_keys(stored, p.persist(), key)) for p in probes])
    assert read == [[[0], [800]], [[0], [1600]], [[0], [1600]], [[0], [1600]]]
    sink(part(700, 900).union(part(5000, 5010)), 4)
    sink(part(0, 3300), 5)  # more than a pace's items
    assert {r.batch_id: r["count"] for r in storage.read_facts(spark, table).groupBy("batch_id").count().collect()} == {
        0: 800, 1: 800, 2: 800, 3: 800, 4: 10, 5: 100,
    }


TAIL = ["trace_id", "span_id", "service_name", "status_code", "start_ns", "attributes"]


def tail_batch(make_spans, *rows):
    day = F.lit("1970-01-01").cast("date")
    made = [{"trace": t, "id": f"{t}-{s}-{i}", "service": "own-x", "start": (3600 + s) * SECOND, "status": e} for i, (t, s, e) in enumerate(rows)]
    return make_spans(made).select(*TAIL).withColumn("event_date", day)


def tail_wave(spark, rows, tmp_path, policy, **times):
    """One restart of the job over one more file; rows that its state holds at the end."""
    source, table = str(tmp_path / "in"), str(tmp_path / "decided")
    rows.coalesce(1).write.mode("append").parquet(source)
    flags = stream_sampling.trace_flags(spark.readStream.schema(rows.schema).parquet(source), policy)
    decided = stream_sampling.decisions(flags, policy, **times)
    query = stream_sampling.land_decisions(decided, table, ingest.Stream(str(tmp_path / "checkpoint")))
    query.awaitTermination()
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"] if op["operatorName"].startswith("transformWithState"))


def decided_so_far(spark, tmp_path):
    return {r.trace_id: (r.is_kept, r.span_count) for r in storage.read_facts(spark, str(tmp_path / "decided"), "trace_id string, is_kept boolean, span_count bigint").collect()}


def test_tail_sampling_waits_and_then_decides(spark, make_spans, tmp_path):
    policy = sampling.Policy(own_services="^own", percentage=0.0)
    # "bad" fails in a span that comes after newer ones, "good" after its wait; "hot" has most spans, in one second.
    hot = [("hot", 2, 0)] * 300
    batches = [[("bad", 0, 0), ("good", 1, 0), *hot], [("good", 8, 0), ("open", 9, 0)], [("bad", 5, 2), ("late", 30, 0)],
               [("good", 25, 2), ("later", 100, 0)], [("last", 1000, 0)]]
    decided, held = [], []
    for rows in batches:
        held.append(tail_wave(spark, tail_batch(make_spans, *rows), tmp_path, policy, remember_seconds=60))
        decided.append(decided_so_far(spark, tmp_path))
    assert decided[0] == {} and decided[1] == {}
    assert decided[2] == {"bad": (True, 2), "hot": (False, 300), "good": (False, 2), "open": (False, 1)}
    assert decided[3] == {**decided[2], "late": (False, 1)}
    assert decided[4] == {**decided[3], "later": (False, 1)}
    assert held[-1] == 0  # flags and markers are gone; "last" is still counted by its second


def test_kept_spans_follow_their_decision(spark, make_spans, tmp_path):
    """Spans that land before, with and after the decision are copied once, whenever runs come or are repeated."""
    policy = sampling.Policy(own_services="^own", percentage=0.0)
    spans, decided, kept = (str(tmp_path / n) for n in ("spans", "decided", "kept"))
    assert stream_sampling.land_kept(spark, spans, decided, kept) is None
    waves = [[("bad", 0, 2), ("good", 0, 0)], [("bad", 5, 0), ("next", 40, 2)], [("bad", 50, 0), ("x", 90, 0)], [("bad", 200, 2), ("y", 300, 0)]]
    found = []
    for number, rows in enumerate(waves):
        wave = tail_batch(make_spans, *rows)
        storage.append_batch(wave, spans, number)
        tail_wave(spark, wave, tmp_path, policy, remember_seconds=60)
        stream_sampling.land_kept(spark, spans, decided, kept)
        assert stream_sampling.land_kept(spark, spans, decided, kept) is None
        if number == 2:
            stream_sampling.compact_landed(spark, spans, decided, kept)
        found.append(sorted((r.trace_id, r.start_ns // SECOND - 3600) for r in storage.read_facts(spark, kept, "trace_id string, start_ns bigint").collect()))
    assert found[0] == []
    assert found[1] == [("bad", 0), ("bad", 5)]
    assert found[2] == [("bad", 0), ("bad", 5), ("bad", 50), ("next", 40)]
    assert found[3] == [("bad", 0), ("bad", 5), ("bad", 50), ("bad", 200), ("next", 40)]
    storage.append_batch(tail_batch(make_spans, ("next", 41, 0)), spans, 4)
    (tmp_path / "kept" / "batch_id=4").mkdir()  # a run that wrote down its reach and then stopped
    spark.createDataFrame([(4, storage.last_batch(spark, decided))], "spans int, decided int").write.parquet(f"{kept}-reach/batch_id=4")
    storage.append_batch(tail_batch(make_spans, ("next", 42, 0)), spans, 5)
    assert [stream_sampling.land_kept(spark, spans, decided, kept) for _ in range(3)] == [4, 5, None]
    assert storage.read_facts(spark, kept).count() == len(found[3]) + 2


def test_a_trace_whose_wait_and_marker_are_over_uses_no_state():
    class Recorder:
        calls = []

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return False

        def get(self):
            return None

        def getCurrentWatermarkInMs(self):
            return self.watermark

        def registerTimer(self, at):
            self.calls.append(("timer", at))

        def update(self, value):
            self.calls.append(("state", value))

    second = Row("second", "span_count", "is_error", "is_http_error", "is_kept_service", "has_own_service")
    rows = [second(120, 4, True, True, True, True), second(105, 2, False, True, False, False), second(100, 1, False, False, False, True)]
    handle, waiting = Recorder(), stream_sampling._waiting(10, 300)
    waiting.init(handle)
    handle.watermark = 410_001
    (decided,) = waiting.handleInputRows(("t",), iter(rows), handle)
    assert tuple(decided) == ("t", 100, 3, False, True, False, True) and not handle.calls
    handle.watermark = 410_000  # the marker may still be asked for
    assert not list(waiting.handleInputRows(("t",), iter(rows), handle))
    assert handle.calls == [("timer", 110_000), ("state", (110, False, 3, False, True, False, True))]


def test_landed_requests_are_compressed(spark, make_spans, tmp_path):
    spans = make_spans([{"id": f"{i:016x}", "service": "checkout"} for i in range(600)])
    text = F.format_string('{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"%s","name":"op"}]}]}]}', "span_id").alias("request")
    requests = envelopes.parse_requests(spans.select(text).repartition(1), "traces")
    ingest.land(requests, "traces", str(tmp_path / "landing"))
    files = list((tmp_path / "landing").glob("part-*"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) * 5 < spans.select(F.sum(F.length(text))).first()[0]
    landed = ingest.read_landing(spark, "traces", str(tmp_path / "landing"))
    options = ingest.Stream(str(tmp_path / "checkpoint"))
    ingest.start(envelopes.flatten_spans(landed), ingest.append_to(str(tmp_path / "facts")), options).awaitTermination()
    found = storage.read_facts(spark, str(tmp_path / "facts"))
    assert sorted(r[0] for r in found.select("span_id").collect()) == [f"{i:016x}" for i in range(600)]
