"""The derived tables, from rows of the tests' own."""

import hashlib
from datetime import datetime

from heliograph.functions import values
from heliograph.operators.attributes import SPAN_KEYS
from heliograph.plans import signals
from heliograph.sources import storage

DAY = datetime(1996, 5, 1)
TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
        [(7, 1, 1, n, 2.0, 10.0, 0.1, "R", DAY) for n in (1, 2, 3)],
    ),
    "orders": ("o_orderkey bigint, o_orderdate timestamp_ntz", [(7, DAY)]),
    "supplier": ("s_suppkey bigint, s_name string", [(1, "s1")]),
    "part": ("p_partkey bigint, p_type string, p_brand string", [(1, "STEEL", "b1")]),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
        [(1, DAY, 4, "click", 1.0, "{}"), (2, DAY, None, None, 1.0, "{}")],
    ),
}


def shuffled_by_range(df):
    """Columns of what a table's range partitioning takes in."""

    def found(node):
        children = node.children()
        own = [node.output().mkString(" ")] if node.nodeName().startswith("RepartitionByExpression") else []
        return own + [text for i in range(children.size()) for text in found(children.apply(i))]

    return found(df._jdf.queryExecution().optimizedPlan())[0]


def test_ids_and_maps_are_made_after_the_shuffle(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spans, logs = (derive(spark, str(tmp_path)) for derive in (signals._derive_spans, signals._derive_logs))
    assert not any(f"{name}_id#" in shuffled_by_range(spans) for name in ("trace", "span", "root"))
    assert "attributes#" not in shuffled_by_range(logs)
    ids = [hashlib.md5(f"7-{seq}".encode()).hexdigest()[:16] for seq in (1, 2, 3)]
    trace = hashlib.md5(b"7").hexdigest()
    rows = spans.orderBy("start_ns").select("trace_id", "span_id", "parent_span_id").collect()
    assert [tuple(r) for r in rows] == [(trace, ids[0], None), (trace, ids[1], ids[0]), (trace, ids[2], ids[0])]
    maps = [set(r[0]) for r in logs.select("attributes").collect()]
    of_spans = sum(i < "8" for i in ids)
    assert maps.count({"event.type", "user.id"}) == 1 and maps.count(set()) == 1 and len(maps) == 2 + of_spans
    assert maps.count({"attributes.span.kind", "span.name", "z.last"}) == of_spans


def test_key_columns_are_made_without_the_map(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spans = signals._derive_spans(spark, str(tmp_path))
    assert "transform_values" not in spans._jdf.queryExecution().optimizedPlan().toString()
    keys = [f"`{key}`" for key in SPAN_KEYS]
    looked_up = [values.any_text(spans["attributes"][key]).alias(key) for key in SPAN_KEYS]
    assert spans.columns[-len(keys) :] == list(SPAN_KEYS)
    assert sorted(map(str, spans.select("span_id", *keys).collect())) == sorted(map(str, spans.select("span_id", *looked_up).collect()))


def test_wide_rows_are_written_by_compiled_code(spark, tmp_path, monkeypatch):
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(limit)
    monkeypatch.setattr(signals, "id_filters", lambda columns: seen.append(spark.conf.get(limit)) or {})
    assert signals._stored(spark, str(tmp_path), "probe", lambda spark, _: spark.range(3)).count() == 3
    assert seen == [storage._METHOD_LIMIT[limit]] and int(seen[0]) <= 8000 and spark.conf.get(limit) == before
