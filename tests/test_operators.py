"""Operators against brute force, on fixtures in which one key holds most of the rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import values
from heliograph.operators import attributes, correlate, filters, genai, logs, metrics, paging, sampling, servicemap, services, spanmetrics, traces
from heliograph.operators.filters import Filter, TimeRange
from heliograph.operators import positions
from heliograph.operators.positions import number_rows
from heliograph.operators import quantiles
from heliograph.operators.quantiles import exact_quantiles, magnitude_bucket


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.choice([0, -5, 7, rng.randrange(10**6), rng.randrange(10**10)])) for _ in range(6000)]


def test_quantiles_match_numpy(spark, skewed):
    rows = [(k, v) for k, v in skewed] + [(None, 3), (None, None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    wanted = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(df, ["k"], "v", wanted, {"n": (F.count("*"), F.sum("n")), "top": (F.max("v"), F.max("top"))})
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        assert found[k].n == len(vs)
        for name, q in wanted.items():
            if known:
                assert found[k][name] == pytest.approx(np.quantile(known, q), abs=1e-3)
            else:
                assert found[k][name] is None


def test_weighted_quantiles(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v bigint")
    grouped = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    plain = exact_quantiles(df, ["k"], "v", {"p": 0.9}).orderBy("k").collect()
    assert exact_quantiles(grouped, ["k"], "v", {"p": 0.9}, weight="w").orderBy("k").collect() == plain


@pytest.mark.parametrize("few", [1, 40, 1000])
def test_wide_ranges_are_divided_until_few_values_are_left(spark, few):
    """One group of distinct minute-long values, all in one or two buckets: no task orders more than ``few`` of them."""
    rng = random.Random(3)
    rows = [("hot", 60 * 10**9 + rng.randrange(10**9)) for _ in range(9000)] + [("hot", 60 * 10**9 + 7)] * 3000 + [(None, v) for v in range(50)]
    rows += [("far", s * (2**62 + i * 10**15)) for i in range(400) for s in (-1, 1)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    histogram = quantiles.bucket_counts(df, ["k"], "v").cache()
    bound = []
    real = quantiles.narrowed

    def watched(*args):
        found = real(*args)
        bound.extend(min(r._n, r._hi - r._lo + 1) for r in found.collect())
        return found

    quantiles.narrowed = watched
    try:
        got = {r.k: r for r in quantiles.select_ranks(histogram, df, ["k"], "v", wanted, few=few).collect()}
    finally:
        quantiles.narrowed = real
    assert max(bound) <= few
    for k in ("hot", None, "far"):
        values = sorted(v for g, v in rows if g == k)
        for name, q in wanted.items():
            at = q * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)


def test_sketches_of_parts_add_up(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v bigint")
    parts = [quantiles.bucket_counts(df.filter(f"pmod(hash(v, k), 3) = {n}"), ["k"], "v") for n in range(3)]
    whole = quantiles.merged_counts(parts[0].union(parts[1]).union(parts[2]), ["k"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, quantiles.bucket_counts(df, ["k"], "v").collect()))


def test_bucket_never_decreases(spark):
    values = sorted({s * (2**e + d) for e in range(62) for d in (-1, 0, 1) for s in (-1, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    buckets = [r[0] for r in df.orderBy("v").select(magnitude_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_positions_match_brute_force(spark, skewed):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(skewed)], "k string, v bigint, i int").repartition(7)
    got = number_rows(df, ["k"], ["v", "i"], "position").collect()
    expected, seen = {}, Counter()
    for k, v, i in sorted((k, v, i) for i, (k, v) in enumerate(skewed)):
        seen[k] += 1
        expected[i] = seen[k]
    assert {r.i: r.position for r in got} == expected


def test_positions_of_usual_and_huge_groups(spark, skewed, monkeypatch):
    monkeypatch.setattr(positions, "USUAL", 260)
    sizes = Counter(k for k, _ in skewed)
    assert min(sizes.values()) <= 260 < max(sizes.values())
    rows = [(k, v, i) for i, (k, v) in enumerate(skewed)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "k string, v bigint, i int").repartition(7)
    numbered = number_rows(df, ["k"], ["v", "i"], "position")
    assert dict(numbered.dtypes)["position"] == "bigint"
    before = {r.i: r.before for r in positions.sum_before(df, ["k"], ["v", "i"], "v", "before").collect()}
    expected, seen, sums = {}, Counter(), Counter()
    for k, v, i in sorted((k, v, i) for k, v, i in rows if k is not None):
        seen[k] += 1
        expected[i] = seen[k]
        assert before[i] == sums[k]
        sums[k] += v
    assert {r.i: r.position for r in numbered.collect()} == expected and set(before) == set(expected)


def test_usual_groups_are_dealt_out_once(spark):
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS v", "repeat('x', 50) AS wide")
    counted = number_rows(df, ["k"], ["v"], "position").groupBy("k").agg(F.collect_list("wide"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def chain(n, trace="t1", service="svc"):
    return [{"trace": trace, "id": f"{trace}{i:05}", "parent": f"{trace}{i - 1:05}" if i else None, "start": i, "end": i + 10, "service": service} for i in range(n)]


def test_tree_of_every_shape(make_spans):
    rows = chain(70, "deep")
    rows += [{"trace": "wide", "id": "root", "start": 5}] + [{"trace": "wide", "id": f"c{i:03}", "parent": "root", "start": 900 - i} for i in range(300)]
    rows += [{"trace": "lost", "id": "r"}, {"trace": "lost", "id": "o1", "parent": "gone"}, {"trace": "lost", "id": "o2", "parent": "o1"}]
    rows += [{"trace": "loop", "id": a, "parent": b} for a, b in ("ab", "bc", "ca")] + [{"trace": "loop", "id": "d", "parent": "a"}, {"trace": "loop", "id": "self", "parent": "self"}]
    rows += [{"trace": "zero", "id": "z", "parent": "0" * 16}, {"trace": "zero", "id": "y", "parent": "z"}]
    depth = {(r.trace_id, r.span_id): r.depth for r in traces.span_tree(make_spans(rows)).collect()}
    assert {k[1]: d for k, d in depth.items() if k[0] == "deep"} == {f"deep{i:05}": i for i in range(70)}
    assert Counter(d for k, d in depth.items() if k[0] == "wide") == {0: 1, 1: 300}
    assert {k: d for k, d in depth.items() if k[0] in ("lost", "loop", "zero")} == {("lost", "r"): 0, ("zero", "z"): 0, ("zero", "y"): 1}


def test_places_in_random_trees(make_spans):
    import random

    rnd = random.Random(3)
    rows = [{"trace": "t", "id": f"s{i:03}", "parent": f"s{rnd.randrange(i):03}" if i and rnd.random() < 0.95 else None, "start": rnd.randrange(20)} for i in range(150)]
    rows += chain(40, "line")
    children = {}
    for r in rows:
        children.setdefault((r["trace"], r["parent"] if r.get("parent") else None), []).append(r)
    places = {}

    def walk(trace, parent, depth):
        for r in sorted(children.get((trace, parent), []), key=lambda r: (r["start"], r["id"])):
            places[r["trace"], r["id"]] = (depth, sum(k[0] == trace for k in places) + 1)
            walk(trace, r["id"], depth + 1)

    for trace in ("t", "line"):
        walk(trace, None, 0)
    got = {(r.trace_id, r.span_id): (r.depth, r.position) for r in traces.span_tree(make_spans(rows)).collect()}
    assert got == places


def test_waterfall_order_and_times(make_spans):
    rows = [
        {"id": "r", "start": 10, "end": 100},
        {"id": "b", "parent": "r", "start": 30, "end": 40},
        {"id": "a", "parent": "r", "start": 20, "end": 150},
        {"id": "b1", "parent": "b", "start": 15, "end": 16},
        {"id": "a1", "parent": "a", "start": 90, "end": 95},
        {"id": "lost", "parent": "gone", "start": 1, "end": 999},
    ]
    drawn = traces.waterfall(make_spans(rows)).orderBy("position").collect()
    assert [(r.span_id, r.depth, r.position, r.offset_ns) for r in drawn] == [
        ("r", 0, 1, 9), ("a", 1, 2, 19), ("a1", 2, 3, 89), ("b", 1, 4, 29), ("b1", 2, 5, 14)]
    assert {r.trace_duration_ns for r in drawn} == {149}


def test_documents_split_a_long_trace(make_spans):
    got = traces.trace_documents(make_spans(chain(25)), part_size=10).orderBy("part").collect()
    assert [(r.part, r.span_count, [s.start_ns for s in r.spans]) for r in got] == [
        (0, 10, list(range(10))), (1, 10, list(range(10, 20))), (2, 5, list(range(20, 25)))]


def test_root_rules(make_spans):
    spans = make_spans([{"id": "child", "parent": "root", "start": 1, "name": "early"}, {"id": "root", "start": 2, "name": "top"}])
    assert traces.trace_summaries(spans).first().root_span_name == "early"
    assert traces.trace_summaries(spans, "parentless").first().root_span_name == "top"
    with pytest.raises(ValueError):
        traces.trace_summaries(spans, "newest")


def test_summary_covers_spans_out_of_the_window(make_spans):
    spans = make_spans([{"id": "a", "start": 100, "end": 130}, {"id": "b", "start": 5000, "end": 5100}, {"trace": "t2", "id": "c", "start": 9000}])
    found = traces.search_traces(spans, TimeRange(4000, 6000)).collect()
    assert [(r.trace_id, r.span_count, r.start_ns, r.end_ns, r.earliest_ns, r.has_more) for r in found] == [("t1", 2, 100, 5100, 5000, False)]


def test_pages_cover_everything_once(make_spans):
    spans = make_spans([{"id": f"s{i:02}", "start": i // 3} for i in range(25)])
    seen, cursor = [], None
    while True:
        page = traces.search_spans(spans, limit=4, cursor=cursor).orderBy(F.desc("start_ns"), "span_id").collect()
        seen += [r.span_id for r in page]
        if not page[-1].has_more:
            break
        cursor = (page[-1].start_ns, page[-1].span_id)
    assert seen == [f"s{i:02}" for i in sorted(range(25), key=lambda i: (-(i // 3), i))]
    oldest = traces.search_spans(spans, limit=3, oldest_first=True).collect()
    assert {r.span_id for r in oldest} == {"s00", "s01", "s02"}
    assert traces.search_spans(spans.limit(0)).count() == 0
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            paging.check_limit(bad)


def map_by_hand(rows):
    """Edges by the rules of the map, span by span."""
    by_key = {(r.get("trace", "t1"), r["id"]): r for r in rows}
    edges = defaultdict(list)
    for r in rows:
        tags, service, kind = r.get("tags", {}), r["service"], r["kind"]
        spent = r["end"] - r["start"]
        edge = None
        if kind == 3:
            target = tags.get("db.name") if tags.get("db.system") else None
            target = target or tags.get("peer.service") or (tags.get("server.address") or "").split(":")[0] or None
            edge = (service, target)
        elif kind == 4 and tags.get("messaging.system"):
            edge = (service, tags.get("messaging.destination.name") or tags.get("messaging.destination"))
        elif kind == 5 and tags.get("messaging.system"):
            edge = (tags.get("messaging.source.name") or tags.get("messaging.destination"), service)
        elif kind < 3:
            parent = by_key.get((r.get("trace", "t1"), r.get("parent")))
            if parent and parent["service"] != service and parent["kind"] != 3:
                edge = (parent["service"], service)
        if edge and edge[0] and edge[1]:
            edges[edge].append((spent, r["status"]))
    return {e: (len(v), sum(s == 2 for _, s in v), sum(d for d, _ in v)) for e, v in edges.items()}


def test_map_matches_rules(make_spans):
    rng = random.Random(3)
    pools = [{}, {"db.system": "pg", "db.name": "shop"}, {"db.system": "pg"}, {"peer.service": "p"}, {"server.address": "h:1"},
             {"messaging.system": "kafka", "messaging.destination": "q"}, {"messaging.destination": "q"},
             {"messaging.system": "kafka", "messaging.source.name": "in", "messaging.destination": "q"}]
    rows = []
    for i in range(600):
        trace = "hot" if i % 3 else f"t{i % 7}"
        earlier = [r for r in rows if r["trace"] == trace]
        parent = earlier[0]["id"] if earlier and i % 2 else (rng.choice(earlier)["id"] if earlier else None)
        start = rng.randrange(1000) * 10**6
        rows.append({"trace": trace, "id": f"s{i}", "parent": parent, "kind": rng.randrange(6), "service": f"svc{rng.randrange(4)}",
                     "status": rng.randrange(3), "start": start, "end": start + rng.choice([0, 1, 5]) * 10**6, "tags": rng.choice(pools)})
    spans = make_spans(rows)
    got = {(r.source, r.target): r for r in servicemap.edges(spans).collect()}
    want = map_by_hand(rows)
    assert {e: (r.call_count, r.error_count) for e, r in got.items()} == {e: v[:2] for e, v in want.items()}
    ids = {r.id: r.type for r in servicemap.nodes(spans).collect()}
    assert set(ids) == {end for e in want for end in e} | {r["service"] for r in rows}
    assert ids["shop"] == "database" and ids["q"] == "messaging" and ids["p"] == "service" and ids["svc0"] == "service"


def test_map_node_types_have_priority(make_spans):
    spans = make_spans([
        {"id": "1", "kind": 3, "service": "a", "tags": {"db.system": "pg", "db.name": "a"}},
        {"id": "2", "kind": 4, "service": "b", "tags": {"messaging.system": "kafka", "messaging.destination": "b"}},
    ])
    nodes = {r.id: (r.type, r.db_system, r.messaging_system) for r in servicemap.nodes(spans).collect()}
    assert nodes == {"a": ("database", "pg", None), "b": ("messaging", None, "kafka")}
    lone = make_spans([{"id": "1", "service": "alone"}])
    assert [(r.id, r.isolated) for r in servicemap.node_metrics(lone).collect()] == [("alone", True)]


def test_filters(make_spans):
    spans = make_spans([
        {"trace": "t1", "id": "1", "kind": 2, "tags": {"http.status_code": "200", "n": "9"}},
        {"trace": "t2", "id": "2", "kind": 3, "tags": {"http.response.status_code": "503", "n": "10"}},
        {"trace": "t3", "id": "3", "kind": 1, "status": 2, "tags": {"http.status_code": "soon"}},
        {"trace": "t4", "id": "4", "kind": 3, "tags": {"http.status_code": "302"}},
    ])

    def ids(*chosen):
        return sorted(r.span_id for r in filters.apply_filters(spans, [Filter(*c) for c in chosen]).collect())

    assert ids(("trace_id", "eq", "t1"), ("trace_id", "equals", "t2")) == ["1", "2"]
    assert ids(("trace_id", "eq", "null")) == [] and ids(("trace_id", "ne", "t1")) == ["2", "3", "4"]
    assert ids(("span_id", "eq", ""), ("span_id", "eq", "null")) == ["1", "2", "3", "4"]
    assert ids(("http_status", "eq", "2xx"), ("http_status", "eq", "5XX")) == ["1", "2"]
    assert ids(("http_status", "eq", "unknown")) == ["3"] and ids(("http_status", "eq", "3xx")) == ["4"]
    assert ids(("n", "gt", "9")) == ["2"] and ids(("n", "lte", 9)) == ["1"] and ids(("n", "eq", 9)) == ["1"]
    assert ids(("span.kind", "eq", "CLIENT"), ("http.status_code", "regex", "^3")) == ["4"]
    assert ids(("status.code", "eq", "ERROR")) == ["3"] and ids(("name", "contains", "p")) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        ids(("name", "like", "x"))


def test_red_names(spark):
    names = ["http.request.count", "total_requests", "Error_Rate", "x.Latency", "a_seconds_bucket", "time_to_response", "size", "requests"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = [r.n for r in df.filter(filters.red_metric(F.col("n"))).collect()]
    assert kept == names[:6]


def test_percentiles_of_catalog(make_spans):
    rows = [{"id": f"s{i}", "service": "a" if i < 30 else "b", "start": 0, "end": i * 10**6, "status": 2 if i % 4 == 0 else 0} for i in range(40)]
    got = {r.service_name: r for r in services.catalog(make_spans(rows)).collect()}
    assert (got["a"].request_count, got["a"].error_count, got["a"].error_rate) == (30, 8, 26.67)
    assert got["a"].p50_latency_ms == 14.5 and got["a"].p95_latency_ms == 27.55 and got["b"].p99_latency_ms == 38.91
    assert services.with_rates(services.red(make_spans(rows)), TimeRange(5, 5)).first().rate_per_minute == 0.0


def test_sampling_policies(make_spans):
    rows = []
    for i in range(400):
        rows.append({"trace": f"own{i}", "id": f"o{i}", "service": "own-x"})
    rows += [{"trace": "err", "id": "e1", "service": "own-x"}, {"trace": "err", "id": "e2", "service": "own-x", "status": 2},
             {"trace": "http", "id": "h", "service": "own-x", "tags": {"http.status_code": "404"}},
             {"trace": "demo", "id": "d", "service": "own-demo"}, {"trace": "demo", "id": "d2", "service": "own-x"},
             {"trace": "foreign", "id": "f", "service": "else"}]
    policy = sampling.Policy(own_services="^own-", keep_services=("demo",))
    spans = make_spans(rows)
    kept = {r.trace_id for r in sampling.decisions(spans, policy).filter("is_kept").collect()}
    assert {"err", "http", "demo", "foreign"} <= kept
    assert 5 <= len([t for t in kept if t.startswith("own")]) <= 40
    assert {r.trace_id for r in sampling.tail_sample(spans, policy).collect()} == kept
    everything = sampling.Policy(own_services="^own-", percentage=100.0)
    assert sampling.tail_sample(spans, everything).count() == len(rows)


def test_counter_expiry(make_spans):
    second = 10**9
    spans = make_spans([{"id": str(i), "start": 0, "end": s * second} for i, s in enumerate((1, 2, 16, 400, 401))])
    deltas = spanmetrics.interval_deltas(spans)
    assert [r.calls for r in spanmetrics.cumulative(deltas).orderBy("flush_ns").collect()] == [2, 3, 5]
    expiring = spanmetrics.cumulative(deltas, expire_ns=300 * second).orderBy("flush_ns").collect()
    assert [r.calls for r in expiring] == [2, 3, 2]
    rows = spanmetrics.bucket_rows(spanmetrics.span_metrics(spans)).orderBy("le_ms").collect()
    assert [r.cumulative_count for r in rows] == [0] * 8 + [1, 2, 2, 5]


def metric_rows(spark, rows):
    from heliograph.functions import values

    df = spark.createDataFrame(rows, "metric_name string, service_name string, time_ns bigint, value double, tags map<string,string>")
    attributes = F.transform_values("tags", lambda _, v: values.any_value(string=v))
    return df.withColumn("attributes", attributes).withColumn("resource", F.create_map(F.lit("service.name"), values.any_value(string=F.col("service_name")))).drop("tags")


def test_metric_series(spark):
    rows = [("m", "a", 1, 1.0, {"x": "1"}), ("m", "b", 2, 5.0, {"x": "1"}), ("m", "a", 3, 2.0, {}), ("m", None, 4, 2.0, {})]
    df = metric_rows(spark, rows)
    split = metrics.detail(df, "m").collect()
    merged = metrics.detail(df, "m", merge_services=True).collect()
    assert len({r.series_key for r in split}) == 3 and len({r.series_key for r in merged}) == 2
    assert {r.label for r in split} == {"x=1", "a"}
    latest = metrics.latest_and_domain(df).first()
    assert (latest.latest_value, latest.domain_low, latest.domain_high) == (2.0, 0.6, 5.4)


def test_series_documents_split_a_long_series(spark):
    rows = [("m", f"svc{i % 2}", i, float(i), {"x": "1"}) for i in range(25)] + [("m", "svc0", 99, 1.0, {}), ("other", "a", 1, 1.0, {})]
    got = metrics.series_documents(metric_rows(spark, rows), "m", merge_services=True, part_size=10).collect()
    parts = sorted((r.label, r.part, [p.time_ns for p in r.datapoints]) for r in got)
    assert parts == [("svc0", 0, [99]), ("x=1", 0, list(range(10))), ("x=1", 1, list(range(10, 20))), ("x=1", 2, list(range(20, 25)))]


def test_sorting_services(make_spans):
    spans = make_spans([{"id": "1", "service": "b"}, {"id": "2", "service": "A"}, {"id": "3", "service": "c", "status": 2}])
    table = services.red(spans)

    def names(by, descending=False):
        return [r.service_name for r in services.sort_services(table, by, descending).collect()]

    assert names("name") == ["A", "b", "c"] and names("error_rate", True)[0] == "c"
    assert all(len(names(by)) == 3 for by in services.SORT_COLUMNS)
    failing = filters.apply_filters(table, [Filter("metrics.error_rate", "gt", 50), Filter("metrics.request_count", "gte", 1)])
    assert [r.service_name for r in failing.collect()] == ["c"]


def test_guard_keeps_first_names(spark):
    rows = [(f"m{i}", "a", 100 - i, 0.0, {}) for i in range(5)] * 2
    df = metric_rows(spark, rows)
    assert {r.metric_name for r in metrics.guard_cardinality(df, 2).collect()} == {"m4", "m3"}
    report = metrics.guard_report(df, 2).first()
    assert tuple(report) == (2, 3, 4, 6, "red")


def test_display_message(spark):
    from heliograph.functions import values

    def row(body, **tags):
        return (body, tags)

    df = spark.createDataFrame([row("hello"), row(" ", **{"attributes.a": "1", "b": "2", "c": "3", "d": "4"}), row("{}"), row("x" * 101)],
                               "body_text string, tags map<string,string>")
    df = df.withColumn("attributes", F.transform_values("tags", lambda _, v: values.any_value(string=v)))
    assert [r[0] for r in df.select(logs.display_message()).collect()] == [
        "hello", '{"a":"1","b":"2","c":"3"}', "-", "x" * 100 + "..."]


def test_orphans_need_both_ids(spark, make_spans):
    spans = make_spans([{"trace": "t", "id": "s"}])
    found = spark.createDataFrame([("t", "s", 1), ("t", "x", 2), (None, "s", 3), ("t", None, 4)], "trace_id string, span_id string, time_ns bigint")
    assert sorted(r.time_ns for r in correlate.orphan_logs(found, spans).collect()) == [2, 3]


def test_map_counts_resent_spans_once(make_spans):
    rows = [
        {"id": "a", "service": "web", "kind": 2, "start": 1, "end": 9},
        {"id": "b", "parent": "a", "service": "api", "kind": 2, "start": 2, "end": 6},
        {"id": "c", "parent": "b", "service": "api", "kind": 3, "start": 3, "end": 5, "tags": {"peer.service": "pay"}},
    ]
    once, thrice = make_spans(rows), make_spans(rows * 3)
    want = {("web", "api", 1), ("api", "pay", 1)}
    for spans in (once, thrice):
        assert {(r.source, r.target, r.call_count) for r in servicemap.edges(spans).collect()} == want
        assert servicemap.parent_child(spans).count() == 1
    figures = {r.id: r.request_count for r in servicemap.node_metrics(thrice).collect()}
    assert figures == {"web": 1, "api": 2, "pay": 0}


def test_hot_trace_is_split(spark):
    """A third of the rows on one trace: the final plan holds a skewed join, whichever operator asks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.advisoryPartitionSizeInBytes"}
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    spans = spark.range(0, 120_000, numPartitions=6).select(
        hot.alias("trace_id"), F.md5(F.col("id").cast("string")).alias("span_id"), F.col("id").alias("start_ns"),
        (F.col("id") + 5).alias("end_ns"), F.lit("own").alias("service_name"), F.lit(0).alias("status_code"),
        F.lit("200").alias("http.status_code"),
    )
    logs = spans.select("trace_id", "span_id", F.col("start_ns").alias("time_ns"))
    policy = sampling.Policy(own_services="^own", percentage=100.0)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for joined in (traces.with_trace_bounds(spans), correlate.trace_logs(logs, spans), sampling.tail_sample(spans, policy)):
            assert joined.count() == 120_000
            joined.write.format("noop").mode("overwrite").save()
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_dedup_keeps_one_copy(make_spans):
    rows = [{"id": "a", "start": 1, "name": "first"}] + [{"id": "a", "start": 2, "name": f"n{i}"} for i in range(50)] + [{"id": "b", "start": 3}]
    spans = make_spans(rows)
    assert sorted((r.span_id, r.name) for r in traces.dedup_spans(spans).collect()) == [("a", "first"), ("b", "op")]
    assert {r.name for r in traces.dedup_spans(spans, ("span_id",), keep="last").collect()} == {"n9", "op"}


def test_dedup_makes_equal_copies_one_without_a_sort(spark, make_spans, monkeypatch):
    monkeypatch.setattr(traces, "broadcast_if_small", lambda side: side)
    plans, written = [], traces.checkpoint
    monkeypatch.setattr(traces, "checkpoint", lambda df: plans.append(df) or written(df))
    narrow = make_spans([{"id": f"{i}", "start": i, "service": None if i % 3 else "svc"} for i in range(40)]).drop("attributes")
    copies = narrow.unionByName(narrow).unionByName(narrow)
    once = traces.dedup_spans(copies, keep="last")
    assert sorted(once.collect()) == sorted(narrow.collect())
    assert not any("SortAggregate" in df._jdf.queryExecution().executedPlan().toString() for df in (once, *plans))
    # Copies that differ are still chosen from.
    changed = narrow.filter("start_ns < 5").withColumn("name", F.lit("changed")).withColumn("end_ns", F.col("end_ns") + 1)
    latest = traces.dedup_spans(copies.unionByName(changed), keep="last")
    first = traces.dedup_spans(copies.unionByName(changed), keep="first")
    assert (latest.count(), latest.filter("name = 'changed'").count()) == (40, 5)
    assert sorted(first.collect()) == sorted(narrow.collect())
    # -0.0 and 0.0 are one to a GROUP BY, so such rows are collapsed by their order.
    zeros = spark.createDataFrame([("t", "a", 0, 0, -0.0)] * 2 + [("t", "b", 0, 0, 0.0)], "trace_id string, span_id string, start_ns bigint, end_ns bigint, x double")
    assert {r.span_id: str(r.x) for r in traces.dedup_spans(zeros).collect()} == {"a": "-0.0", "b": "0.0"}


def test_counters_are_dealt_out_once(spark):
    schema = ", ".join([f"{d} string" for d in spanmetrics.DIMENSIONS] + [f"{c} bigint" for c in ("flush_ns", *spanmetrics.FIGURES)])
    figures = [1] * len(spanmetrics.FIGURES)
    rows = [(s, None, "k", "st", None, "200", flush, *figures) for s in ("a", None) for flush in (10, 20, 20, 900)]
    counted = spanmetrics.cumulative(spark.createDataFrame(rows, schema), 100)
    assert counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
    assert counted.columns == [*spanmetrics.DIMENSIONS, "flush_ns", *spanmetrics.FIGURES]
    found = sorted((str(r.service_name), r.flush_ns, r.calls) for r in counted.collect())
    assert found == [(s, flush, calls) for s in ("None", "a") for flush, calls in ((10, 1), (20, 3), (900, 1))]


def test_genai_roles(make_spans):
    spans = make_spans([
        {"id": "1", "tags": {"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": "3", "gen_ai.usage.output_tokens": "4.7"}},
        {"id": "2", "name": "Tool x"}, {"id": "3", "tags": {"agent.tool.name": "t"}}, {"id": "4"},
        {"id": "5", "name": "tool", "tags": {"gen_ai.system": "s", "gen_ai.model": "n", "gen_ai.usage.prompt_tokens": "5"}},
    ])
    row = genai.sessions(spans).first()
    assert (row.ai_spans, row.tool_spans, row.other_spans, row.prompt_tokens, row.completion_tokens, row.total_tokens, row.models) == (2, 2, 1, 8, 4, 12, "m,n")


def test_key_columns_share_one_pass_over_the_map(make_spans):
    spans = make_spans([{"id": "a", "tags": {"http.method": "GET", "db.name": "d"}}, {"id": "b"}])
    apart = spans.withColumns({key: values.attribute_value(spans, key) for key in attributes.SPAN_KEYS})
    once = attributes.with_key_columns(spans)
    assert once.columns == apart.columns
    keys = ["span_id", *[f"`{key}`" for key in attributes.SPAN_KEYS]]
    assert {r[0]: r for r in once.select(keys).collect()} == {r[0]: r for r in apart.select(keys).collect()}
    # An expression of its own per key, a lookup per field in each, made tasks generate and compile code for seconds.
    lookups = [df.select(keys)._jdf.queryExecution().optimizedPlan().expressions().mkString().count("string_value") for df in (once, apart)]
    assert lookups[0] <= 1 and lookups[1] >= len(attributes.SPAN_KEYS)
