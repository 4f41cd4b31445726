"""What stays on disk after a step."""

import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from heliograph.llm import packing, pieces
from heliograph.operators import traces
from heliograph.plans import signals
from heliograph.sources import storage
from heliograph.streaming import ingest
from heliograph.streaming.sampling import state_on_disk


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def table_folders(spark):
    return set(Path(storage._tables_dir(spark).removeprefix("file:")).glob("*"))


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = storage.checkpoint(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert rows.count() == 1000


def test_a_waterfall_keeps_what_it_returns(spark, make_spans):
    chain = [{"id": f"{i:04d}", "parent": f"{i - 1:04d}" if i else None, "start": i, "end": i + 1} for i in range(40)]
    before = table_folders(spark)
    drawn = traces.waterfall(make_spans(chain))
    assert len(table_folders(spark) - before) == 2  # drawn spans and bounds; each round kept a table before
    assert [(r.depth, r.position) for r in drawn.orderBy("span_id").collect()] == [(i, i + 1) for i in range(40)]


def test_a_tree_with_missing_ids_two_roots_and_a_cycle(spark, make_spans):
    rows = [
        {"id": "a", "start": 5}, {"id": "b", "start": 1}, {"id": "c", "parent": "a", "start": 6}, {"id": "d", "parent": "c", "start": 7},
        {"id": "x", "parent": "y", "start": 2}, {"id": "y", "parent": "x", "start": 3}, {"id": "z", "parent": "gone", "start": 1},
        {"id": None, "start": 0}, {"id": "n", "trace": None, "start": 0}, {"id": "e", "parent": "b", "start": 9},
        {"id": "a", "trace": "t2", "start": 1}, {"id": "w", "parent": "z", "start": 2},
    ]
    spans = make_spans(rows)
    tree = {(r.trace_id, r.span_id): (r.depth, r.position) for r in traces.span_tree(spans).collect()}
    assert tree == {("t1", "b"): (0, 1), ("t1", "e"): (1, 2), ("t1", "a"): (0, 3), ("t1", "c"): (1, 4), ("t1", "d"): (2, 5), ("t2", "a"): (0, 1)}


def test_pieces_are_handed_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(packing, "MOST_IDS", 8)
    texts = ["one two three", None, "four five six seven eight nine ten", ""] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(20), pa.int64()), "text": texts})
    got = list(packing._cutter(pieces.vocabulary(), 4, 2, True, memo=3)(iter([batch])))
    assert len(got) > 5 and max(sum(b["length"].to_pylist()) for b in got) < 8 + 4  # one batch before
    monkeypatch.undo()
    whole = list(packing._cutter(pieces.vocabulary(), 4, 2, True)(iter([batch])))
    assert len(whole) == 1 and [r for b in got for r in b.to_pylist()] == whole[0].to_pylist()


def test_state_codec_is_set_inside_only(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.compression"
    before = spark.conf.get(name, None)
    with state_on_disk(spark):
        assert spark.conf.get(name) == "zstd"
    assert spark.conf.get(name, None) == before


def test_a_derived_table_leaves_only_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(signals, "_WHOLE", 10)
    before, tables, written = shuffle_files(spark), table_folders(spark), []

    def finish(part):
        written.append(part.count())
        return part.repartitionByRange(2, "at").select("at", F.md5(F.col("i").cast("string")).alias("trace_id"))

    rows = lambda spark, _: storage.checkpoint(spark.range(300).selectExpr("IF(id % 10 = 0, NULL, id) AS at", "id AS i").repartition(3, "i"))
    stored = signals._stored(spark, str(tmp_path), "left-over", rows, finish)
    assert len(written) == signals._SLICES and all(80 <= n <= 130 for n in written) and sum(written) == 300
    assert sorted(r.at or -1 for r in stored.collect()) == sorted(i if i % 10 else -1 for i in range(300))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table_folders(spark) == tables
    assert any("zstd" in f.name for f in Path(storage.shared_dir(spark).removeprefix("file:")).glob("signals-*/*/left-over/*.parquet"))


def test_a_batch_is_kept_as_a_table_while_it_is_used(spark):
    before = table_folders(spark)
    with storage.kept(spark.range(5).withColumn("n", F.rand())) as rows:
        assert len(table_folders(spark) - before) == 1 and rows.collect() == rows.collect()
    assert table_folders(spark) == before


def test_fan_out_caches_nothing(spark, tmp_path, make_spans):
    seen = []

    def sink(batch, batch_id):
        seen.append((batch.count(), spark.sparkContext._jsc.getPersistentRDDs().size(), batch.storageLevel.useMemory))

    ingest.fan_out(sink, sink)(make_spans([{"id": "a"}, {"id": "b"}]), 0)
    assert seen == [(2, 0, False)] * 2


def test_a_batch_of_a_stream_with_state_is_rebalanced(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "DATE'2024-01-01' AS event_date", "md5(string(id)) AS trace_id", "md5(string(id)) AS span_id")
    with storage._set(spark, {"spark.sql.adaptive.enabled": "false"}):  # as in such a stream's session
        storage.append_batch(rows.repartition(8), str(tmp_path / "t"), 0)
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    files = list((tmp_path / "t").glob("batch_id=0/event_date=*/*.parquet"))
    assert len(files) == 1 and files[0].stat().st_size < 400_000  # two filters had half a megabyte whatever they held


def test_state_takes_no_space_beforehand(spark):
    with state_on_disk(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate") == "false"
