"""Streams against the batch result over the same rows, late files included."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glasswork.streaming.drift import drift, reference_shares
from glasswork.streaming.scoring import score_stream
from registry.streams import EVENT_LINE, scored_events


def run_stream(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def feed(spark, rows, folder, schema):
    """One Parquet file per call, read one per micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_drift_on_events_equals_batch(spark, sf, tmp_path):
    """All events in time order, hour windows: the stream gives the batch rows of every window that the watermark closed."""
    from glasswork.operators.score import score

    rows = scored_events(spark, sf)
    shares = reference_shares(rows)
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    for day in range(1, 31, 6):
        part = events.filter(F.dayofmonth("ts").between(day, day + 5))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    scored = score(stream.withColumn("y", (F.col("event_type") == "purchase").cast("int")), EVENT_LINE)
    got = {r.start: r for r in run_stream(spark, drift(scored, "ts", shares, every="6 hours", late="30 minutes", y="y"), tmp_path, "drift_events").collect()}
    want = {r.start: r for r in drift(rows, "ts", shares, every="6 hours", y="y").collect()}
    latest = events.agg(F.max("ts")).first()[0]
    closed = {s for s, r in want.items() if r.end <= latest - timedelta(minutes=30)}
    assert closed and closed <= set(got) and set(got) <= set(want)
    for start, row in got.items():
        assert row.counts == want[start].counts and row.n == want[start].n
        assert row.psi == pytest.approx(want[start].psi, abs=1e-9) and row.positive_share == pytest.approx(want[start].positive_share)


def test_late_rows(spark, tmp_path):
    """A row inside the allowed lateness counts, one behind the watermark is dropped, null scores and times are left out."""
    schema, folder = "ts timestamp, p double", tmp_path / "in"
    noon = datetime(2024, 1, 1, 12)
    at = lambda minutes: noon + timedelta(minutes=minutes)
    feed(spark, [(at(5), 0.05), (at(30), 0.95), (at(31), None), (None, 0.5)], folder, schema)
    feed(spark, [(at(65), 0.35)], folder, schema)
    feed(spark, [(at(50), 0.95), (at(100), 1.0)], folder, schema)   # 50 is late but allowed: the watermark is at 55 - window end 60
    feed(spark, [(at(200), 0.0)], folder, schema)
    feed(spark, [(at(10), 0.5), (at(300), -3.0)], folder, schema)   # 10 is behind the watermark
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = run_stream(spark, drift(stream, "ts", [0.5, 0.0, 0.0, 0.5], score="p", every="60 minutes", late="10 minutes"), tmp_path, "late_rows")
    rows = {r.start: r for r in got.collect()}
    assert rows[noon].counts == [1, 0, 0, 2] and rows[noon].n == 3
    assert rows[at(60)].counts == [0, 1, 0, 1]
    batch = drift(spark.read.schema(schema).parquet(str(folder)), "ts", [0.5, 0.0, 0.0, 0.5], score="p", every="60 minutes")
    assert {r.start: r.counts for r in batch.collect()}[noon] == [1, 0, 1, 2]


def test_drift_of_nothing(spark):
    empty = spark.createDataFrame([], "ts timestamp, p double")
    assert reference_shares(empty, "p", 4) == [0.25] * 4 and drift(empty, "ts", [0.25] * 4, score="p").collect() == []


def test_scoring_needs_a_stream(spark):
    with pytest.raises(ValueError):
        score_stream(spark.range(1), EVENT_LINE)
