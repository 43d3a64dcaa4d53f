"""Monitoring jobs composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.operators import drift as D
from driftwell.operators import rules as R
from driftwell.operators.logs import recent_logs


@dataclass
class ModelConfig:
    """What the monitoring of one model needs; unset fields come from the task type."""

    model_id: str
    task_type: str = "classification"
    version: str = "v1"
    feature_names: list[str] = field(default_factory=list)
    drift_test: str | None = None
    primary_metric: str | None = None
    data_source: str | None = None
    retrain_trigger: str | None = None
    monitor_drift: bool | None = None

    def __post_init__(self) -> None:
        test, metric, source, trigger, monitored = config.TASK_DEFAULTS.get(self.task_type, config.FALLBACK_TASK)
        self.drift_test = self.drift_test or test
        self.primary_metric = self.primary_metric or metric
        self.data_source = self.data_source or source
        self.retrain_trigger = self.retrain_trigger or trigger
        self.monitor_drift = monitored if self.monitor_drift is None else self.monitor_drift


def config_table(spark, configs: list[ModelConfig]) -> DataFrame:
    rows = [
        (c.model_id, c.task_type, c.drift_test, c.primary_metric, c.data_source, c.retrain_trigger, c.monitor_drift)
        for c in configs
    ]
    return spark.createDataFrame(
        rows,
        "model_id string, task_type string, drift_test string, primary_metric string, data_source string, "
        "retrain_trigger string, drift_monitored boolean",
    )


def drift_all_models(samples: DataFrame, configs: list[ModelConfig], include_unmonitored: bool = False,
                     min_points: int = config.MIN_POINTS, chunks: int | None = None) -> DataFrame:
    """Every feature of every configured model, each with its model's own test.

    Models are grouped by test and the model filter is pushed into the scan, so a
    model's rows are read only for the test it uses.
    """
    out: DataFrame | None = None
    for method in D.METHODS:
        models = [
            c.model_id for c in configs if c.drift_test == method and (c.monitor_drift or include_unmonitored)
        ]
        if not models:
            continue
        part = D.drift(samples.filter(F.col("model_id").isin(models)), method, chunks=chunks)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no model is monitored")
    return out.filter(F.col("sample_size") >= min_points)


def drift_check(reference: DataFrame, logs: DataFrame, configs: list[ModelConfig],
                limit: int | None = None, chunks: int | None = None) -> DataFrame:
    """All logs given (or the newest `limit` of every model) against the stored reference values.

    `reference` is the long table (model_id, feature_name, value). A feature without
    reference or with fewer than five points yields no report.
    """
    recent = logs if limit is None else recent_logs(logs, limit)
    current = D.feature_samples(recent, F.lit(False))
    return drift_all_models(D.pair_samples(reference, current), configs, chunks=chunks)


def drift_alerts(reports: DataFrame, rules: list[tuple] | None = None, chunks: int | None = None) -> DataFrame:
    """Alerts for the detected drifts of a report table."""
    metrics = reports.filter("drift_detected").select(
        F.lit("drift_score").alias("metric"), "model_id", F.col("statistic").alias("value"),
        F.col("analyzed_at").alias("at"), F.col("feature_name").alias("id"),
    )
    return R.evaluate_alerts(metrics, rules or config.DEFAULT_ALERT_RULES, chunks=chunks)


def health(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, errors and mean latency per key."""
    return logs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
