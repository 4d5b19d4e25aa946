"""Streams give what their batch forms give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewatch.streaming import mutations

START = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(p, START + timedelta(minutes=m)) for p, minutes in ((1, (0, 10, 21, 50)), (2, (0, 5))) for m in minutes] + [(9, START + timedelta(days=2))]
    path = f"{tmp_path}/events"
    spark.createDataFrame(rows, "page_id long, ts timestamp").write.parquet(path)
    return path


def test_gap_of_the_duration_continues(spark, folder):
    got = {(r.page_id, r.events) for r in mutations.debounced(spark.read.parquet(folder), "10 minutes").collect()}
    assert got == {(1, 2), (1, 1), (2, 2), (9, 1)}


def test_debounce_on_a_stream(spark, folder, tmp_path):
    stream = spark.readStream.schema("page_id long, ts timestamp").parquet(folder)
    query = mutations.debounced(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {tuple(r) for r in mutations.debounced(spark.read.parquet(folder), "10 minutes").filter("page_id <> 9").collect()}
    assert {tuple(r) for r in spark.table("fired").collect()} == batch


def test_latest_state_on_a_stream(spark, folder, tmp_path):
    stream = spark.readStream.schema("page_id long, ts timestamp").parquet(folder).withColumn("v", F.minute("ts"))
    query = mutations.latest_state(stream, "page_id", "ts", "v").writeStream.format("memory").outputMode("complete").queryName("state").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.page_id: r.v for r in spark.table("state").collect()} == {1: 50, 2: 5, 9: 0}


def test_ingest(spark, tmp_path):
    spark.createDataFrame([("a", '{"page":{"domain":"d","url":"http://d"}}'), ("b", "x")], "key string, body string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, body string").parquet(f"{tmp_path}/in")
    query = mutations.ingest(stream, lambda df, n: df.filter("status = 201").write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def minutes(n):
    return START + timedelta(minutes=n)


def test_as_of(spark):
    from tidewatch.operators import asof

    changes = spark.createDataFrame([(1, minutes(5), 1, "a"), (1, minutes(5), 2, "b"), (1, minutes(200), 3, "c"), (2, minutes(0), 4, None), (None, minutes(0), 5, "x"), (3, None, 6, "y")], "k long, ts timestamp, n long, v string")
    rows = [(1, 4), (1, 5), (1, 59), (1, 190), (1, 200), (1, 2000), (2, 1), (3, 9), (None, 9), (1, None), (1, 5)]
    asked = spark.createDataFrame([(i, k, None if m is None else minutes(m)) for i, (k, m) in enumerate(rows)], "i long, k long, ts timestamp")
    for bucket in (3600, 60, 30 * 86400):
        got = {r.i: r.v for r in asof.as_of(asked, changes, "k", "ts", ["v"], ["n"], bucket).collect()}
        assert got == dict(enumerate([None, "b", "b", "b", "c", "c", None, None, None, None, "b"]))
    assert asof.as_of(asked.limit(0), changes, "k", "ts", ["v"]).collect() == [] and asof.as_of(asked, changes.limit(0), "k", "ts", ["v"]).filter("v IS NOT NULL").count() == 0


def test_completion_order_on_a_stream(spark, tmp_path):
    """Of page 1 what starts second completes first; the latest state follows completion, and what is still under way isn't told."""
    started = [(1, minutes(0), minutes(9), 10), (1, minutes(1), minutes(2), 11), (1, minutes(3), minutes(400), 12), (2, minutes(1), minutes(1), 20), (9, minutes(60), minutes(60), 90)]
    later = [(1, minutes(70), minutes(71), 13), (9, minutes(500), minutes(501), 91), (9, minutes(2000), minutes(2001), 92)]
    schema = "page long, ts timestamp, done timestamp, decision long"
    for n, rows in enumerate((started, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = mutations.in_completion_order(stream, "page", "ts", "done", "decision")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = spark.read.parquet(f"{tmp_path}/out")
        told = {r.page: r.decision for r in mutations.latest_state(got, "page", "done", "decision").collect()}
        assert told == ({1: 10, 2: 20}, {1: 12, 2: 20, 9: 91})[n]
    # all that the last watermark passed, once each
    batch = spark.createDataFrame(started + later, schema).filter(F.col("done") <= F.lit(minutes(1999)))
    assert sorted(map(tuple, got.select("page", "done", "decision").collect())) == sorted(map(tuple, batch.select("page", "done", "decision").collect()))


def test_switch_on_a_stream(spark, tmp_path):
    from tidewatch.operators import asof

    rows = [(1, minutes(0), None, 1), (1, minutes(1), True, None), (1, minutes(2), None, 2), (2, minutes(2), None, 3), (1, minutes(5), False, None), (1, minutes(6), None, 4), (2, minutes(1), True, None)]
    late = [(1, minutes(8), None, 5), (2, minutes(9), None, 6), (1, minutes(10), True, None), (1, minutes(11), None, 7)]
    schema = "page long, ts timestamp, ready_now boolean, id long"
    for part in (rows, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = mutations.switched(stream, "page", "ts", "ready_now").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    whole = spark.createDataFrame(rows + late, schema)
    batch = asof.as_of(whole.filter("id IS NOT NULL").select("page", "ts", "id"), whole.filter("id IS NULL").select("page", "ts", F.col("ready_now").alias("ready")), "page", "ts", ["ready"]).na.fill({"ready": False})
    assert {r.id: r.ready for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {r.id: r.ready for r in batch.collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}


def test_collection_cycles(spark):
    loads = spark.createDataFrame([(1, True), (2, False), (3, None)], "page long, loading boolean")
    got = sorted((r.page, r.cycle, r.trigger) for r in mutations.collection_cycles(loads).collect())
    assert got == [(1, 0, "document_start"), (1, 1, "DOMContentLoaded"), (1, 2, "load"), (2, 0, "document_start"), (3, 0, "document_start")]
