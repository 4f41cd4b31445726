import json

import pytest
from pyspark.sql import functions as F

from heliograph.operators import filters
from heliograph.operators.attributes import promote_attribute
from heliograph.operators.filters import Filter, TimeRange
from heliograph.operators.sides import broadcast_if_small
from heliograph.sources import storage

DAY = 86_400 * 10**9


def facts(spark, *times):
    from heliograph.functions import clocks

    df = spark.createDataFrame([(f"t{t}", t) for t in times], "trace_id string, time_ns bigint")
    return df.withColumn("event_date", clocks.event_date(F.col("time_ns")))


@pytest.mark.parametrize("grain", ["day", "month"])
def test_batches_replay_and_commit(spark, tmp_path, grain):
    path = str(tmp_path / "facts")
    storage.append_batch(facts(spark, 0, DAY, 40 * DAY), path, 0, grain)
    storage.append_batch(facts(spark, 2 * DAY), path, 1, grain)
    storage.append_batch(facts(spark, 3 * DAY), path, 1, grain)
    (tmp_path / "facts" / "batch_id=7").mkdir()
    assert len(storage.committed_batches(spark, path)) == 2
    stored = storage.read_facts(spark, path)
    assert sorted(r.time_ns for r in stored.collect()) == [0, DAY, 3 * DAY, 40 * DAY]
    window = filters.in_range(stored, TimeRange(DAY, 4 * DAY))
    assert sorted(r.time_ns for r in window.collect()) == [DAY, 3 * DAY]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert f"isnotnull({storage.GRAINS[grain]}" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        storage.read_facts(spark, str(tmp_path / "none"))
    assert storage.read_facts(spark, str(tmp_path / "none"), "a int").count() == 0


def test_retention_and_inventory(spark, tmp_path):
    df = facts(spark, 0, DAY, 5 * DAY, 5 * DAY + 1)
    assert storage.retain(df, 4 * DAY + 1).count() == 3
    assert storage.retain_by_clock(df, 6 * DAY, 2 * DAY).count() == 2
    path = str(tmp_path / "facts")
    storage.append_batch(df, path, 0)
    storage.append_batch(facts(spark, 0), path, 1)
    days = {str(r.event_date): (r.row_count, r.file_count, r.age_days) for r in storage.partition_inventory(storage.read_facts(spark, path)).collect()}
    assert days == {"1970-01-01": (2, 2, 5), "1970-01-02": (1, 1, 4), "1970-01-06": (2, 1, 0)}
    summary = storage.inventory_summary(storage.read_facts(spark, path)).first()
    written = sum(f.stat().st_size for f in (tmp_path / "facts").rglob("part-*.parquet"))
    assert tuple(summary) == (3, 5, written, "1970-01-01", 5)
    assert len(storage.drop_expired(spark, path, "1970-01-05", 3)) == 2
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == [DAY, 5 * DAY, 5 * DAY + 1]
    assert not storage.drop_expired(spark, path, "1970-01-05", 3)


def test_months_that_reach_into_the_kept_time_stay(spark, tmp_path):
    path = str(tmp_path / "facts")
    storage.append_batch(facts(spark, 0, 40 * DAY, 70 * DAY), path, 0, "month")
    assert len(storage.drop_expired(spark, path, "1970-03-10", 30, "month")) == 1
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == [40 * DAY, 70 * DAY]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_compaction_keeps_rows_and_order_of_batches(spark, tmp_path, grain):
    path = str(tmp_path / "facts")
    for number, days in enumerate(((0,), (1, 2), (2, 40), (41,))):
        storage.append_batch(facts(spark, *[d * DAY for d in days]), path, number, grain)
    want = sorted(r.time_ns for r in storage.read_facts(spark, path).collect())
    assert storage.compact(spark, path, grain) == 2
    assert len(storage.committed_batches(spark, path)) == 2
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == want
    assert {r.batch_id for r in storage.read_facts(spark, path).select("batch_id").distinct().collect()} == {2, 3}
    storage.append_batch(facts(spark, 41 * DAY), path, 3, grain)  # the newest batch once more
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == want
    storage.append_batch(facts(spark, 50 * DAY), path, 4, grain)
    assert storage.compact(spark, path, grain) == 3 and storage.compact(spark, path, grain) is None
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == [*want, 50 * DAY]
    window = filters.in_range(storage.read_facts(spark, path), TimeRange(40 * DAY, 51 * DAY))
    assert sorted(r.time_ns for r in window.collect()) == [40 * DAY, 41 * DAY, 50 * DAY]


def test_compaction_rewrites_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "facts")
    for number, days in enumerate(((0, 1, 2), (3,), (1, 4), (5,))):
        storage.append_batch(facts(spark, *[d * DAY for d in days]), path, number)

    def files():
        return {f.relative_to(path).parts[-2:]: f.parent.parent.name for f in tmp_path.rglob("compacted/batch_id=*/*/*.parquet")}

    assert storage.compact(spark, path, "day", upto=1) == 1
    before = files()
    assert storage.compact(spark, path, "day", upto=2) == 2
    untouched = {name: version for name, version in before.items() if name[0] != "event_date=1970-01-02"}
    after = files()
    assert len(untouched) == 3 and untouched.items() <= after.items()
    assert {name[0]: version for name, version in after.items() if version == "batch_id=2"}.keys() == {"event_date=1970-01-02", "event_date=1970-01-05"}
    assert sorted(r.time_ns // DAY for r in storage.read_facts(spark, path).collect()) == [0, 1, 1, 2, 3, 4, 5]


def test_compaction_that_stops_before_it_cleans_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    for number, days in enumerate(((0, 1), (1, 2), (2,), (3,))):
        storage.append_batch(facts(spark, *[d * DAY for d in days]), path, number)
    storage.compact(spark, path, "day", upto=0)
    want = sorted(r.time_ns for r in storage.read_facts(spark, path).collect())
    real = storage._finished
    calls = []

    def broken(spark, path):  # the first listing after the write fails
        calls.append(path)
        if len(calls) == 3:
            raise OSError("lost")
        return real(spark, path)

    monkeypatch.setattr(storage, "_finished", broken)
    with pytest.raises(OSError):
        storage.compact(spark, path, "day", upto=2)
    monkeypatch.setattr(storage, "_finished", real)
    assert (tmp_path / "facts" / "batch_id=1").exists() and (tmp_path / "facts" / "compacted" / "batch_id=2").exists()
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == want
    storage.append_batch(facts(spark, 9 * DAY), path, 4)
    assert storage.compact(spark, path, "day") == 3
    assert sorted(r.time_ns for r in storage.read_facts(spark, path).collect()) == [*want, 9 * DAY]
    assert not (tmp_path / "facts" / "batch_id=1").exists()


def test_empty_batches_are_rolled_in(spark, tmp_path):
    path = str(tmp_path / "facts")
    for number, days in enumerate(((), (0,), ())):
        storage.append_batch(facts(spark, *[d * DAY for d in (*days, 7)]).filter(f"time_ns < {7 * DAY}"), path, number)
    assert storage.compact(spark, path, "day", upto=0) == 0
    assert storage.compact(spark, path, "day", upto=2) == 2
    assert [r.time_ns for r in storage.read_facts(spark, path).collect()] == [0]


def test_lookups_by_id_skip_row_groups(spark, tmp_path, scanned_rows):
    path = str(tmp_path / "spans")

    def part(lo, hi):
        ids = spark.range(lo, hi)
        return ids.select(
            F.md5((F.col("id") % 7).cast("string")).alias("trace_id"), F.md5(F.col("id").cast("string")).alias("span_id"),
            F.lit("2024-01-01").cast("date").alias("event_date"),
        )

    for number in range(3):
        storage.append_batch(part(number * 500, number * 500 + 500), path, number)
    one = part(600, 601).first()
    stored = storage.read_facts(spark, path)
    assert scanned_rows(filters.apply_filters(stored, [Filter("span_id", "eq", one.span_id)])) == [500]
    assert scanned_rows(filters.apply_filters(stored, [Filter("trace_id", "eq", "0" * 32)])) == [0]
    ids = [r.span_id for r in part(10**6, 10**6 + 300).collect()]
    assert scanned_rows(stored.filter(storage.among("span_id", ids))) == [0]
    found = stored.filter(storage.among("span_id", [*ids, one.span_id]))
    assert [r.span_id for r in found.collect()] == [one.span_id] and scanned_rows(found) == [500]
    assert stored.filter(storage.among("span_id", [])).count() == 0


def test_release_removes_materialised_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    kept = storage.checkpoint(spark.range(3).toDF("a"))
    assert kept.count() == 3 and list(tmp_path.glob("tables-*/*"))
    storage.release(spark)
    assert not list(tmp_path.glob("tables-*"))


@pytest.mark.parametrize("file_format", ["json", "csv", "parquet"])
def test_export(spark, tmp_path, file_format):
    path = str(tmp_path / file_format)
    storage.export(facts(spark, 0, 1), path, file_format)
    back = spark.read.option("header", True).format(file_format).load(path)
    assert back.count() == 2 and set(back.columns) == {"trace_id", "time_ns", "event_date"}
    with pytest.raises(ValueError):
        storage.export(facts(spark, 0), path, "xml")


def test_json_rows(spark):
    row = storage.as_json(facts(spark, 5).withColumn("none", F.lit(None).cast("string"))).first()
    assert json.loads(row.json) == {"trace_id": "t5", "time_ns": 5, "event_date": "1970-01-01", "none": None}


def test_promoted_key_is_pushed_down(spark, tmp_path, make_spans):
    spans = make_spans([{"id": "1", "tags": {"db.name": "x", "k": "v"}}, {"id": "2", "tags": {"k": "w"}}])
    path = str(tmp_path / "promoted")
    promote_attribute(spans, "db.name").write.parquet(path)
    found = filters.apply_filters(spark.read.parquet(path), [Filter("db.name", "eq", "x")])
    assert "EqualTo(db.name,x)" in found._jdf.queryExecution().executedPlan().toString().replace("`", "")
    assert [(r.span_id, set(r.attributes)) for r in found.collect()] == [("1", {"k"})]


def test_broadcast_only_when_counted_small(spark):
    small, large = spark.range(5), spark.range(50)
    hint = "broadcast"
    assert hint in broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString()
    assert hint not in broadcast_if_small(large, 10)._jdf.queryExecution().logical().toString()
