"""Event streams: sources, dispatch by type, dead letters, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.schemas import INFERENCE_EVENT
from driftwell.session import scratch_path

Handler = Callable[[DataFrame, int], None]


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """The Parquet file or folder at a path as a stream. Without `max_files` a micro-batch takes all that is there.

    The path is given as a pattern that only fits itself, as a stream takes a plain path for a folder.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def kafka_stream(spark: SparkSession, servers: str, topic: str = "inference-events") -> DataFrame:
    """Raw JSON events of a topic from the latest offset (needs the Kafka package on the cluster)."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "latest").load()
        .select(F.col("value").cast("string").alias("json"), "topic", "offset")
    )


def parse(raw: DataFrame, schema: str = INFERENCE_EVENT) -> DataFrame:
    """Parse `json`; unparsable text keeps its row with `error` set."""
    parsed = F.from_json("json", f"{schema}, _corrupt_record string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.withColumn("event", parsed).withColumn(
        "error",
        F.when(F.col("event").isNull() | F.col("event._corrupt_record").isNotNull(), F.lit("malformed event"))
        .when(F.col("event.model_id").isNull(), F.lit("model_id is required")),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").select("event.*").drop("_corrupt_record")


def dead_letters(parsed: DataFrame, topic: str = "inference-events", max_retries: int = 3) -> DataFrame:
    """Rejected events with what a dead-letter topic records."""
    offset = F.col("offset") if "offset" in parsed.columns else F.lit(None).cast("bigint")
    return parsed.filter("error IS NOT NULL").select(
        F.col("json").alias("original_event"), F.lit(topic).alias("source_topic"), offset.alias("offset"),
        "error", F.lit(max_retries).alias("max_retries"),
    )


def route(batch: DataFrame, batch_id: int, handlers: dict[str, Handler], default: Handler | None = None) -> None:
    """Give each event type to its handler; other types go to the default or are skipped.

    The batch is kept while its handlers run, so that its source is read once.
    """
    batch = batch.persist()
    try:
        for kind, handler in handlers.items():
            handler(batch.filter(F.col("event_type") == kind), batch_id)
        if default is not None:
            known = F.coalesce(F.col("event_type").isin(list(handlers)), F.lit(False))
            default(batch.filter(~known), batch_id)
    finally:
        batch.unpersist()


def routed_stream(stream: DataFrame, handlers: dict[str, Handler], checkpoint: str,
                  default: Handler | None = None, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: route(batch, batch_id, handlers, default)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def table_handler(path: str) -> Handler:
    """Write a batch under its own id: a batch that runs again after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stream_stats(parsed: DataFrame, handled_types: list[str] | None = None) -> DataFrame:
    """Processed, failed and dead-letter counts of a batch or a finished stream."""
    ok = F.col("error").isNull()
    handled = ok if handled_types is None else ok & F.col("event.event_type").isin(handled_types)
    return parsed.agg(
        F.count_if(handled).alias("processed"), F.count_if(~ok).alias("errors"), F.count_if(~ok).alias("dlq")
    )


def observed(parsed: DataFrame, name: str = "events") -> DataFrame:
    """Attach the counters to a stream; they show up in its progress reports."""
    return parsed.observe(
        name, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("dlq"),
    )


def publish(events: DataFrame) -> DataFrame:
    """Rows as JSON messages."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stored_counts(stream: DataFrame, count: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Drain a stream, count every micro-batch on its own, and read the counts back (with their `batch_id`).

    A batch that runs again after a failure replaces its own counts.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    seen: list = []

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = count(batch)
        seen[:] = [counts.schema]
        counts.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(store)
    writer.trigger(availableNow=True).start().awaitTermination()
    if not seen:  # nothing to read, so no batch ran
        return count(spark.createDataFrame([], stream.schema)).withColumn("batch_id", F.lit(0))
    return spark.read.parquet(f"{path}/data")
