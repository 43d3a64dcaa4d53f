import time

import pytest
from pyspark.sql import functions as F

from driftwell.operators.rules import evaluate_alerts
from driftwell.plans.catalog import QUERIES, streams
from driftwell.plans.catalog.base import rounded
from driftwell.plans.catalog.rules import RULES
from driftwell.session import scratch_path
from driftwell.streaming import monitor
from driftwell.streaming import windows as W


def split_files(spark, tiny, parts=4):
    """The events in several files of rising time, written one after the other, so that a stream sees them in order."""
    path = scratch_path(spark, "parts")
    events = spark.read.parquet(f"{tiny}/events.parquet")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    place = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * parts / (high - low + 1))
    for i in range(parts):
        events.filter(place == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, events


def unsorted_folder(spark, tiny, parts=6):
    """A table folder of several files, each with events of all times, and the same rows in one file."""
    path = scratch_path(spark, "table")
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(parts, F.xxhash64("event_id")).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["request_rate", "error_rate", "latency_quantiles"])
def test_streams_equal_their_batch_twins(spark, tiny, name):
    twin = {"error_rate": "error_rate_gauge"}.get(name, name)
    want = sorted(map(tuple, QUERIES[twin](spark, tiny).collect()))
    folder = unsorted_folder(spark, tiny)
    for max_files in (None, 1):
        got = getattr(streams, f"stream_{name}")(spark, folder, max_files)
        assert sorted(map(tuple, rounded(got, 6).collect())) == want
    assert sorted(map(tuple, QUERIES[f"stream_{name}"](spark, tiny).collect())) == want


@pytest.mark.parametrize("name", ["source_stream_events", "stream_dead_letter", "stream_stats", "stream_route_events", "sink_stream_events"])
def test_streams_read_table_folders(spark, tiny, name):
    rows = lambda folder: sorted(map(str, QUERIES[name](spark, folder).collect()))
    assert rows(unsorted_folder(spark, tiny)) == rows(tiny) != []


def test_alert_cooldown_carries_over_batches(spark, tiny):
    path, events = split_files(spark, tiny)
    rules = [r for r in RULES if r[1] == "latency_ms"]

    def points(e):
        return e.select(
            F.lit("latency_ms").alias("metric"), F.lit("m").alias("model_id"), F.col("ts").cast("timestamp").alias("at"),
            F.col("value").alias("value"), F.col("event_id").alias("id"),
        )

    out = scratch_path(spark, "alerts")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    monitor.stream_alerts(points(stream), rules, f"{out}/alerts", f"{out}/state", available_now=True).awaitTermination()
    streamed = spark.read.parquet(f"{out}/alerts")
    assert streamed.select("batch_id").distinct().count() > 1
    batch = evaluate_alerts(points(events), rules)
    spans = streamed.groupBy("batch_id").agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy("batch_id").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))
    key = ["rule_name", "id"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_alert_state_survives_a_restart(spark, tiny):
    """A second query on the same checkpoint goes on from the first one's state: its alerts are those of the whole table."""
    folder, events = scratch_path(spark, "restart"), spark.read.parquet(f"{tiny}/events.parquet")
    rules = [r for r in RULES if r[1] == "latency_ms"]
    ids = events.agg(F.percentile_approx("ts", [0.3, 0.31, 0.7])).first()[0]
    cuts = [None, *ids, None]

    def points(e):
        return e.select(
            F.lit("latency_ms").alias("metric"), F.lit("m").alias("model_id"), F.col("ts").cast("timestamp").alias("at"),
            F.col("value").alias("value"), F.col("event_id").alias("id"),
        )

    out = scratch_path(spark, "alerts")
    for low, high in zip(cuts, cuts[1:]):
        part = events if low is None else events.filter(F.col("ts") >= F.lit(low))
        part = part if high is None else part.filter(F.col("ts") < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        monitor.stream_alerts(points(stream), rules, f"{out}/alerts", f"{out}/state", available_now=True).awaitTermination()
    streamed = spark.read.parquet(f"{out}/alerts")
    batch = evaluate_alerts(points(events), rules)
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect())) != []
    assert spark.conf.get(monitor.STORE, None) != monitor.ROCKSDB


def test_bucket_quantile(spark):
    sql = W.bucket_quantile(["b0", "b1", "b2"], [1.0, 2.0], 0.5)
    df = spark.createDataFrame([(1, 4, 10), (5, 10, 10), (0, 0, 0), (0, 0, 3), (0, 10, 10)], "b0 int, b1 int, b2 int")
    got = [r[0] for r in df.selectExpr(f"{sql} AS q").collect()]
    assert got == [2.0, 1.0, None, 2.0, 1.5]


def test_drop_repeats_and_feedback_join_are_valid_streams(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(tiny)
    logs = stream.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit(None).cast("double").alias("ground_truth"))
    assert W.drop_repeats(logs, ["id"]).isStreaming
    given = stream.select(F.col("event_id").alias("id"), F.lit(1.0).alias("ground_truth"), F.col("ts").cast("timestamp").alias("received_at"))
    joined = W.join_feedback(W.with_lateness(logs), given.withWatermark("received_at", "10 minutes"))
    assert joined.columns == ["id", "created_at", "ground_truth"]
