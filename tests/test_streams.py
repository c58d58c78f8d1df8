"""Streams with state, their own source, and scans that supersede one another."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from reelmill.operators import progress, volumes
from reelmill.streaming import live
from reelmill.streaming.generations import Generations

REPORTED = "label string, seq long, at_s double, fraction double"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.with_rocks(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def some_reports(n):
    rows = [(f"l{i % 3}", i, i / 4.0 + (i % 7), None if i % 9 == 0 else (i % 50) / 2000.0) for i in range(n)]
    return [(a, b, c, d) for a, b, c, d in rows]


def test_a_throttled_stream_is_what_the_batch_shows_and_goes_on_after_a_restart(rocks, tmp_path):
    spark, rows = rocks, some_reports(240)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    expected = sorted(map(str, progress.shown(spark.createDataFrame(rows, REPORTED)).collect()))
    for at in range(0, 240, 60):  # each run begins anew from the checkpoint
        spark.createDataFrame(rows[at : at + 60], REPORTED).coalesce(1).write.mode("append").json(source)
        stream = live.throttled(spark.readStream.schema(REPORTED).option("maxFilesPerTrigger", 1).json(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(map(str, got.collect())) == expected and 20 < len(expected) < 240
    assert got.groupBy("label", "seq").count().where("count > 1").isEmpty()


def test_a_report_that_is_held_is_shown_by_a_timer(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0.0, 0.1), ("a", 2, 0.1, 0.1001), ("b", 1, 0.0, 0.5)], REPORTED).coalesce(1).write.json(source)
    stream = live.throttled(spark.readStream.schema(REPORTED).json(source), hold=0.2)
    query = stream.writeStream.format("memory").queryName("held_reports").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(120):
            if spark.table("held_reports").count() == 3:
                break
            time.sleep(0.5)
        assert sorted((r.label, r.seq) for r in spark.table("held_reports").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    finally:
        query.stop()


def test_probes_are_published_by_rows_and_a_restart_goes_on(spark, tmp_path):
    folder, sizes = tmp_path / "found", []
    folder.mkdir()

    def add(name, first, n):
        (folder / f"{name}.json").write_text("".join(json.dumps({"path": f"/{i}", "document": "{}"}) + "\n" for i in range(first, first + n)))

    def run():
        got = []

        def keep(rows, batch):
            rows = [r.path for r in rows.collect()]
            got.extend(rows)
            if rows:
                sizes.append(len(rows))

        stream = live.published(spark, str(folder), "path string, document string")
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return got

    add("1", 0, 7)
    add("2", 7, 53)
    assert run() == [f"/{i}" for i in range(60)] and sizes == [25, 25, 10]
    add("3", 60, 5)
    assert run() == [f"/{i}" for i in range(60, 65)] and sizes == [25, 25, 10, 5]


def test_stuck_and_back_are_told_once(spark, tmp_path):
    source, told = str(tmp_path / "answers"), []
    listener = live.Edges(lambda event, path: told.append((event, path)))
    spark.streams.addListener(listener)
    try:
        for i, up in enumerate((False, False, True)):
            spark.createDataFrame([("/v", up, i), ("/w", True, i)], volumes.ANSWER).coalesce(1).write.mode("append").json(source)
            stream = live.watched(spark.readStream.schema(volumes.ANSWER).json(source))
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(40):
            if len(told) > 1:
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(listener)
    assert told == [("stuck", "/v"), ("back", "/v")]


def test_only_the_newest_scan_goes_on(spark):
    runs, began = Generations(spark), threading.Event()

    def slow(stale):
        began.set()
        return spark.range(0, 400, 1, 4).select(F.udf(lambda i: time.sleep(1) or i, "long")("id").alias("id"))

    first = runs.start(slow, lambda df: df.count() if df.columns == [] else len(df.collect()))
    assert began.wait(30)
    time.sleep(1.5)
    start = time.monotonic()
    second = runs.start(lambda stale: spark.range(10), lambda df: df.count())
    runs.wait(60)
    assert runs.published == {second: 10} and first != second and time.monotonic() - start < 60
    assert not any(t.is_alive() for t in runs.running.values())
