"""System tables derived from the event, order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.tables import table

REFERENCE_END = "2024-01-16"
FEATURES = ["f0", "f1", "f2"]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def from_events(e: DataFrame) -> DataFrame:
    """Prediction log rows: three features per request, labels on purchases and views."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model_id"),
        F.when(F.col("event_id") % 10 == 0, F.lit("v2")).otherwise(F.lit("v1")).alias("model_version"),
        F.array(F.col("value"), k.cast("double"), F.hour("ts").cast("double")).alias("features"),
        (k % 2).cast("double").alias("result"),
        (0.5 + k / 200.0).alias("confidence"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.col("event_type") == "purchase", F.lit(1.0))
        .when(F.col("event_type") == "view", F.lit(0.0)).alias("ground_truth"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("entity_id"),
    )


def prediction_logs(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(events(spark, folder))


def is_reference():
    return F.col("created_at") < F.lit(REFERENCE_END).cast("timestamp_ntz")


def feature_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every event type is a feature of its user; clicks expire after seven days."""
    return events(spark, folder).select(
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("feature"),
        "value",
        F.col("ts").alias("event_ts"),
        F.when(F.col("event_type") == "click", F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )


def registry_events(spark: SparkSession, folder: str) -> DataFrame:
    """A registry log from orders: customers are models, order priority and status give the action."""
    o = table(spark, folder, "orders")
    digit = F.col("o_orderkey") % 10
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("at"),
        F.concat(F.lit("model-"), F.pmod("o_custkey", F.lit(200)).cast("string")).alias("model_id"),
        F.concat(F.lit("1."), F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit(".0")).alias("version"),
        F.when(digit < 5, F.lit("save")).when(digit < 9, F.lit("stage")).otherwise(F.lit("rollback")).alias("action"),
        F.when(digit < 4, F.lit("challenger")).when(digit == 4, F.lit("champion"))
        .when(digit < 7, F.lit("champion")).when(digit == 7, F.lit("archived"))
        .when(digit == 8, F.lit("staging")).alias("stage"),
        F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("uri"),
        F.lit("onnx").alias("framework"),
        F.create_map(F.lit("accuracy"), F.col("o_totalprice") / 1e6).alias("metrics"),
    )


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """A training-job log from line items: lines of an order are its status changes."""
    li = table(spark, folder, "lineitem")
    status = (
        F.when(F.col("l_linenumber") == 1, F.lit("pending"))
        .when(F.col("l_linenumber") == 2, F.lit("running"))
        .when(F.col("l_returnflag") == "R", F.lit("failed"))
        .when(F.col("l_returnflag") == "A", F.lit("completed"))
        .otherwise(F.lit("cancelled"))
    )
    # Lines of an order are spread over years; a job's clock runs on the line number instead.
    at = F.timestamp_micros((F.col("l_orderkey") * 100000 + F.col("l_linenumber").cast("bigint") * 600
                             + F.col("l_quantity").cast("bigint")) * 1000000)
    return li.select(
        F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("m"), F.pmod("l_orderkey", F.lit(3)).cast("string")).alias("model_id"),
        status.alias("status"),
        at.cast("timestamp_ntz").alias("at"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment runs from orders; every 11th accuracy is NaN and every 13th run has none."""
    o = table(spark, folder, "orders")
    accuracy = F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1e6)
    return o.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("experiment_name"),
        F.concat(F.lit("type-"), F.col("o_orderstatus")).alias("model_type"),
        F.create_map(F.lit("note"), F.repeat(F.col("o_orderpriority"), 40)).alias("params"),
        F.when(F.col("o_orderkey") % 13 == 0, F.create_map(F.lit("loss"), F.lit(1.0)))
        .otherwise(F.create_map(F.lit("accuracy"), accuracy, F.lit("loss"), F.lit(1.0) - F.col("o_totalprice") / 1e6))
        .alias("metrics"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 3600).cast("decimal(18,6)"))).alias("end_time"),
    )


def dirty_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """A training table with gaps: every seventh value and every fifth count are null."""
    e = events(spark, folder)
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("double")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("income"),
        F.when(F.col("event_id") % 5 != 0, k).alias("age"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("category"),
        (F.col("event_type") == "error").cast("int").alias("target"),
    )


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "text", "quality"
    )
