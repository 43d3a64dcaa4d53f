"""Drift checks and alerts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftwell.operators.rules import alert_columns, breaches
from driftwell.operators.spacing import NEVER, keep_spaced
from driftwell.plans.checks import ModelConfig, drift_check
from driftwell.schemas import ALERT_RULES

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_drift(logs: DataFrame, reference: DataFrame, configs: list[ModelConfig], path: str, checkpoint: str,
                 interval: str = "30 seconds", available_now: bool = False) -> StreamingQuery:
    """Test every micro-batch against the stored reference; reports are written per batch id,
    so a batch that runs again replaces its own reports."""

    def check(batch: DataFrame, batch_id: int) -> None:
        reports = drift_check(reference, batch, configs).withColumn("analyzed_at", F.current_timestamp())
        reports.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _cooldown(expire_ms: int | None):
    """Keyed state of one rule: the time of its last alert."""

    class Cooldown(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last_fired", "at_us bigint", expire_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            points = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "model_id", "id"], na_position="first", kind="stable")
            gap = int(points["gap_us"].iloc[0])
            start = int(self.last.get()[0]) if self.last.exists() else NEVER
            kept, last = keep_spaced(points["at_us"].to_numpy(), gap, False, start)
            if kept:
                self.last.update((last,))
                yield points.iloc[kept][["rule_name", "model_id", "at_us", "id", "value"]]

        def close(self) -> None:
            pass

    return Cooldown()


def stream_alerts(metrics: DataFrame, rules: list[tuple], path: str, checkpoint: str,
                  interval: str = "30 seconds", available_now: bool = False, expire_ms: int | None = None) -> StreamingQuery:
    """Alerts of a metric stream (metric, model_id, value, at, id).

    The cooldown is keyed state: one value per rule, the time of its last alert, kept in the stream's own state store.
    It survives restarts with the same checkpoint and is never read or written as a whole. A rule's breaches of one
    micro-batch meet in one task; the source's rate limit bounds them. `expire_ms` lets the state of rules that have
    been silent that long, by the clock, go; without it a rule's state is one number for good. Texts are put together
    after the state, from the rule table.
    """
    spark = metrics.sparkSession
    table = spark.createDataFrame(rules, ALERT_RULES)
    gap = F.round(F.col("cooldown_seconds") * 1_000_000).cast("bigint")
    hits = breaches(metrics, table).select(
        "rule_name", "model_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "id", F.col("value").cast("double").alias("value"), gap.alias("gap_us"))
    id_type = hits.schema["id"].dataType.simpleString()
    fired = hits.groupBy("rule_name").transformWithStateInPandas(
        _cooldown(expire_ms), f"rule_name string, model_id string, at_us bigint, id {id_type}, value double",
        outputMode="Append", timeMode="None" if expire_ms is None else "ProcessingTime")
    alerts = fired.withColumn("at", F.timestamp_micros("at_us")).join(table, "rule_name").select(*alert_columns())

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    # Keyed state of this kind lives in RocksDB; a query takes the setting when it starts.
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
