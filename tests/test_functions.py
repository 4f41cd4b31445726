import pytest
from pyspark.sql import functions as F

from heliograph.functions import clocks, enums, identifiers, nested, values, web


def column(spark, inputs, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids(spark):
    given = ["AQIDBAUGBwgJCgsMDQ4PEA==", "AQIDBAUGBwg=", "0102030405060708", "5B8EFFF798038103D269B633813FC60C", "",
             "not-valid-base64!!!", "not-hex-invalid", "AAAAAAAAAAAAAAAAAAAAAA==", None]
    assert column(spark, given, "string", identifiers.hex_id) == [
        "0102030405060708090a0b0c0d0e0f10", "0102030405060708", "0102030405060708",
        "5b8efff798038103d269b633813fc60c", "", "not-valid-base64!!!", "not-hex-invalid", "0" * 32, None]
    assert column(spark, ["", "ab"], "string", identifiers.optional_hex_id) == [None, "ab"]


def test_enums(spark):
    kinds = ["SPAN_KIND_SERVER", "2", "SPAN_KIND_CONSUMER", "other", None]
    assert column(spark, kinds, "string", enums.span_kind) == [2, 2, 5, 0, 0]
    assert column(spark, ["STATUS_CODE_ERROR", "1", "?", None], "string", enums.status_code) == [2, 1, 0, None]
    severities = ["9", "SEVERITY_NUMBER_ERROR", None, "UNKNOWN", "SEVERITY_NUMBER_WARN3"]
    assert column(spark, severities, "string", enums.severity_number) == [9, 17, None, 0, 15]
    temporalities = ["AGGREGATION_TEMPORALITY_CUMULATIVE", "1", "DELTA", "", None]
    assert column(spark, temporalities, "string", enums.temporality) == ["CUMULATIVE", "DELTA", "DELTA", None, None]
    assert len(enums.SEVERITIES) == 25 and enums.SEVERITIES[24] == "FATAL4" and enums.SEVERITIES[13] == "WARN"
    assert enums.SEVERITY_RANGES["ERROR"] == (17, 20)


TIMES = [
    (1769362245123456789, "2026-01-25T17:30:45.123456789Z"),
    (1769378244074228326, "2026-01-25T21:57:24.074228326Z"),
    (1741503600000000000, "2025-03-09T07:00:00.000000000Z"),
    (1741503599000000005, "2025-03-09T06:59:59.000000005Z"),
]


def test_clocks(spark, zone):
    nanos, texts = zip(*TIMES)
    assert column(spark, nanos, "bigint", clocks.rfc3339) == list(texts)
    assert column(spark, texts, "string", clocks.parse_rfc3339) == list(nanos)
    assert [clocks.parse_bound(t) for t in texts] == list(nanos)
    assert column(spark, nanos[:1], "bigint", clocks.nanos_fraction) == [789]
    back = column(spark, nanos, "bigint", lambda ns: clocks.from_timestamp(clocks.to_timestamp(ns), clocks.nanos_fraction(ns)))
    assert back == list(nanos)
    assert [str(d) for d in column(spark, nanos, "bigint", clocks.event_date)] == [t[:10] for t in texts]


def test_rfc3339_input(spark):
    given = ["2026-01-25T17:30:45Z", "2026-01-25T17:30:45", "2026-01-25T17:30:45.1234567891Z", "2026-01-25T18:30:45+01:00", "x"]
    second = 1769362245000000000
    assert column(spark, given, "string", clocks.parse_rfc3339) == [second, second, second + 123456789, second, None]
    assert [clocks.parse_bound(g) for g in given[:4]] == [second, second, second + 123456789, second]
    with pytest.raises(ValueError):
        clocks.parse_bound("x")


def test_duration_and_log_time(spark):
    row = spark.range(1).select(
        clocks.duration_seconds(F.lit(10**18), F.lit(10**18 + 10**9)).alias("d"),
        clocks.log_time(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"), F.lit(9).cast("bigint")).alias("observed"),
        clocks.log_time(F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(9).cast("bigint")).alias("arrived"),
    ).first()
    assert (row.d, row.observed, row.arrived) == (1.0, 7, 9)


def test_urls(spark):
    given = ["http://h.example/a/b?x=1#y", "https://USER:pw@Host.Example:8443", "http://h", "/only/path", "http://h/a b?q",
             "http://[::1]:80/z", "http://h/p;v=1?q", None, ""]
    assert column(spark, given, "string", web.url_path) == ["/a/b", "/", "/", "/only/path", "/a b", "/z", "/p", None, "/"]
    assert column(spark, given, "string", web.url_host) == [
        "h.example", "host.example", "h", None, "h", "::1", "h", None, None]


def test_any_values(spark):
    df = spark.range(1).select(
        values.any_value(string=F.lit("test")).alias("s"),
        values.any_value(integer=F.lit(42)).alias("i"),
        values.any_value(double=F.lit(1.5)).alias("d"),
        values.any_value(boolean=F.lit(False)).alias("b"),
        values.any_value().alias("n"),
    )
    texts = df.select(*[values.any_text(F.col(c)).alias(c) for c in df.columns]).first()
    assert list(texts) == ["test", "42", "1.5", "false", None]
    assert list(df.select(*[values.value_type(F.col(c)) for c in df.columns]).first()) == ["string", "int", "double", "bool", "other"]
    assert list(df.select(*[values.body_type(F.col(c)) for c in df.columns]).first()) == ["STRING", "INT", "DOUBLE", "BOOL", "EMPTY"]


def test_canonical_hash_ignores_order(spark):
    def built(*pairs):
        return values.attribute_map({k: values.any_value(string=F.lit(v)) for k, v in pairs})

    row = spark.range(1).select(
        identifiers.attributes_hash(built(("a", "1"), ("b", "2"))).alias("ab"),
        identifiers.attributes_hash(built(("b", "2"), ("a", "1"))).alias("ba"),
        identifiers.attributes_hash(built(("a", "1"))).alias("a"),
        identifiers.canonical_json(built(("b", "2"), ("a", "1"))).alias("json"),
        values.series_label(built(("b", "2"), ("a", "1")), F.lit("svc")).alias("label"),
        values.series_label(built(), F.lit(None).cast("string")).alias("bare"),
    ).first()
    assert row.ab == row.ba != row.a
    assert row.json == '{"a":{"string_value":"1"},"b":{"string_value":"2"}}'
    assert (row.label, row.bare) == ("a=1, b=2", "default")


def test_attribute_maps_are_made_by_compiled_code(spark):
    rows = spark.createDataFrame([("x", 1, None), (None, None, None), ("", 2, 0.5)], "s string, i bigint, d double")
    parts = {"s": values.any_value(string=F.col("s")), "i": values.any_value(integer=F.col("i")), "d": values.any_value(double=F.col("d"))}
    made = rows.select(values.attribute_map({**parts, "b": values.any_value(boolean=F.lit(True)), "none": values.any_value()}).alias("m"))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.schema["m"].dataType == rows.select(F.lit(None).cast(values.ATTRIBUTES).alias("m")).schema["m"].dataType
    texts = made.select(F.transform_values("m", lambda _, v: values.any_text(v))).collect()
    assert [r[0] for r in texts] == [{"s": "x", "i": "1", "b": "true"}, {"b": "true"}, {"s": "", "i": "2", "d": "0.5", "b": "true"}]


def test_targets(make_spans):
    df = make_spans([
        {"id": "1", "tags": {"db.system": "pg", "db.name": "shop", "peer.service": "x"}},
        {"id": "2", "tags": {"db.system": "pg", "peer.service": "x"}},
        {"id": "3", "tags": {"db.system": "pg"}},
        {"id": "4", "tags": {"server.address": "h:80", "http.url": "http://u/"}},
        {"id": "5", "tags": {"net.peer.name": "n"}},
        {"id": "6", "tags": {"url.full": "http://U.example/"}},
        {"id": "7", "tags": {}},
    ])
    found = [r[0] for r in df.orderBy("span_id").select(web.client_target(df)).collect()]
    assert found == ["shop", "x", None, "h", "n", "u.example", None]


def test_nested_values_keep_their_types(spark):
    leaf = '{"stringValue":"a \\"quoted\\" é"}'
    deep = leaf
    for _ in range(6):
        deep = f'{{"arrayValue":{{"values":[{deep}]}}}}'
    rows = [
        ("array", '{"values":[{"intValue":"5"},{"boolValue":false},{"double_value":2.5},{"bytesValue":"AQI="},{},%s]}' % leaf, None),
        ("kvlist", None, '{"values":[{"key":"k","value":{"int_value":"1"}},{"key":"k","value":{"int_value":"2"}},{"key":"in.ner","value":{"kvlist_value":{"values":[{"key":"x","value":{"intValue":7}}]}}}]}'),
        ("deep", '{"values":[%s]}' % deep, None),
        ("broken", "not json", None),
        ("empty", '{"values":[]}', None),
    ]
    df = spark.createDataFrame(rows, "name string, a string, p string")
    value = F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("string_value", "string"), ("int_value", "string"), ("double_value", "double"), ("bool_value", "boolean"))],
                     F.col("a").alias("array_value"), F.col("p").alias("kvlist_value"), F.lit(None).cast("string").alias("bytes_value"))
    v = nested.as_variant(value)
    got = {r.name: r for r in df.select("name", F.to_json(v).alias("json"),
           nested.at_path(v, "$[0]", "bigint").alias("whole"), nested.at_path(v, "$['in.ner'].x", "int").alias("inner"),
           nested.at_path(v, "$[0][0][0][0].values[0].arrayValue.values[0].arrayValue.values[0].stringValue", "string").alias("tagged")).collect()}
    assert got["array"].json == '[5,false,2.5,"AQI=",null,"a \\"quoted\\" é"]' and got["array"].whole == 5
    assert got["kvlist"].json == '{"in.ner":{"x":7},"k":2}' and got["kvlist"].inner == 7
    assert got["deep"].tagged == 'a "quoted" é'
    assert got["broken"].json is None and got["empty"].json == "[]"
    scalars = [values.any_value(string=F.lit('x"y')), values.any_value(integer=F.lit(3)), values.any_value(double=F.lit(float("nan"))), values.any_value(boolean=F.lit(True)), values.any_value()]
    row = spark.range(1).select(*[F.to_json(nested.as_variant(v)).alias(f"c{i}") for i, v in enumerate(scalars)]).first()
    assert tuple(row) == ('"x\\"y"', "3", '"NaN"', "true", None)
