import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def zone(spark):
    """Run under a session time zone far from UTC, with daylight saving gaps."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


SPAN_SCHEMA = (
    "trace_id string, span_id string, parent_span_id string, name string, kind int, status_code int, "
    "start_ns bigint, end_ns bigint, service_name string, tags map<string,string>"
)


@pytest.fixture
def make_spans(spark):
    """Span rows from dicts; ``tags`` become string attributes."""
    from pyspark.sql import functions as F

    from heliograph.functions import values

    def make(rows):
        filled = [
            (
                r.get("trace", "t1"),
                r["id"],
                r.get("parent"),
                r.get("name", "op"),
                r.get("kind", 2),
                r.get("status", 0),
                r.get("start", 0),
                r.get("end", r.get("start", 0)),
                r.get("service", "svc"),
                r.get("tags", {}),
            )
            for r in rows
        ]
        df = spark.createDataFrame(filled, SPAN_SCHEMA)
        attributes = F.transform_values("tags", lambda _, v: values.any_value(string=v))
        return df.withColumn("attributes", attributes).withColumn("status_message", F.lit(None).cast("string")).drop("tags")

    return make


@pytest.fixture(scope="session")
def scanned_rows():
    """Rows that each file scan of a query hands on, once it has run."""

    def scans(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            return [node.metrics().apply("numOutputRows").value()]
        if name.startswith("AdaptiveSparkPlan"):
            return scans(node.executedPlan())
        if name.endswith("QueryStage"):
            return scans(node.plan())
        children = node.children()
        return [n for i in range(children.size()) for n in scans(children.apply(i))]

    def run(df):
        df.collect()
        return scans(df._jdf.queryExecution().executedPlan())

    return run
