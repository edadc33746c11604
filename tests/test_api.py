"""The engine's front: SQL over views, hybrid search, reports, batches and observers."""

import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import batch, chunking
from codeloom.plans.api import CodeIndex
from codeloom.streaming import events, ingest, observe

from conftest import SMALL


@pytest.fixture(scope="module")
def index(spark):
    return CodeIndex(spark, SMALL)


def test_sql_over_views(index):
    got = index.sql("SELECT count(*) AS n FROM function f JOIN contains c ON c.dst = f.id AND c.kind = 'file_function'").collect()[0].n
    assert got == index.sql("SELECT count(*) AS n FROM function").collect()[0].n


def test_search_kinds(spark, index):
    name = index.tables()["function"].orderBy("name").first().name
    q = spark.createDataFrame([(20, f"where is {name} defined"), (40, None), (60, "")], "query_id bigint, text string")
    both = index.search(q, 3).collect()
    assert {r.query_id for r in both} <= {20, 60} and any(r.source != "vector" for r in both)
    assert all(r.source == "graph" for r in index.search(q, 3, "graph").collect())
    assert all(r.source == "vector" for r in index.search(q, 3, "vector").collect())
    with pytest.raises(ValueError):
        index.search(q, kind="other")
    named = spark.createDataFrame([(1, name)], "query_id bigint, name string")
    assert index.explain(named, kind="graph").collect()[0].answer.startswith("Found ")
    assert index.search_by_function(named, kind="graph").count() >= 1 and index.search_by_class(named, kind="graph").count() >= 1
    path = index.tables()["chunk"].first().file_path
    assert all(r.file_path == path for r in index.search_by_file(q, path, kind="vector").collect())


def test_split_by_first_lines(spark):
    files = spark.createDataFrame([("a", "a.py", "import x\n\ndef f(a):\n    pass\nclass A:\n    def g(self): pass\nz = 1"), ("b", "b.js", None), ("c", "c.md", "def f(): x"), ("d", "d.ts", "")], "file_id string, path string, content string")
    got = sorted((r.file_id, r.start_line, r.end_line) for r in chunking.split(files, "function").collect())
    assert got == [("a", 3, 4), ("a", 6, 7)]
    assert [(r.start_line, r.end_line) for r in chunking.split(files, "class").collect()] == [(5, 7)]


def test_failing_items_fail_alone(spark):
    rows = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, v string")
    got = {r.id: (r.n, r.error) for r in batch.mapped(rows, lambda r: {"n": int(r["v"])}, "n bigint", "id").collect()}
    assert got[1] == (4, None) and got[2][0] is None and got[2][1].startswith("ValueError") and got[3][1].startswith("TypeError")


def test_counters(spark):
    rows, seen = observe.counted(spark.range(10), "ten", even=F.count_if(F.col("id") % 2 == 0))
    rows.collect()
    assert seen.get == {"rows": 10, "even": 5}


def test_stream_events(spark, tmp_path):
    spark.range(5).withColumn("last_updated", F.lit(1)).write.parquet(str(tmp_path / "in"))
    told = []
    listener = observe.StreamEvents().on(told.append, ["PIPELINE_STARTED", "PIPELINE_COMPLETED"])
    spark.streams.addListener(listener)
    try:
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        ingest.Index(spark, str(tmp_path / "index")).run(ingest.feed(spark, str(tmp_path / "in"), schema))
        for _ in range(50):
            if len(told) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["kind"] for t in told] == ["PIPELINE_STARTED", "PIPELINE_COMPLETED"]


def test_late_events_and_watermarks(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:00:00', 'a', 1D), (TIMESTAMP '2024-01-01 07:00:00', 'a', 2D) t(ts, event_type, value)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = events.drained(spark, events.windowed(stream, "6 hours", late="1 hour"), "w").collect()
    assert sorted((r.n, r.total) for r in got) == [(1, 1.0), (1, 2.0)]


def test_event_log_keeps_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("ERROR", 1), ("WARNING", 2)], "kind string, n int")
    events.event_log(rows, str(tmp_path / "log"), ["ERROR"])
    assert [r.kind for r in spark.read.json(str(tmp_path / "log")).collect()] == ["ERROR"]
