"""Self-healing: alert, roll back, export, retrain, log the run, register the model.

Every step appends its rows to a ledger under the run's id, and the registry state is read back from there. Registry
events of a run are numbered after all others, so replaying base events and ledger gives the state; running the same
id again gives the same rows once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell import schemas
from driftwell.operators import rules as R
from driftwell.operators.history import registry_state
from driftwell.operators.training import Trained, train_challenger
from driftwell.plans.checks import ModelConfig, drift_alerts, drift_check, health
from driftwell.plans.exports import export_training, require_samples
from driftwell.plans.ledger import RUN, Ledger
from driftwell.session import scratch_path

ALERTS = (
    "rule_name string, severity string, status string, metric_value double, threshold double, message string, "
    "model_id string, at timestamp, id string"
)
DECISIONS = (
    "model_id string, model_version string, should_rollback boolean, reason string, error_rate double, avg_latency_ms double"
)
LOGS = {
    "reports": schemas.DRIFT_REPORTS, "alerts": ALERTS, "decisions": DECISIONS, "rollbacks": schemas.REGISTRY_EVENTS,
    "references": schemas.REFERENCE_FEATURES, "runs": schemas.RUNS, "saves": schemas.REGISTRY_EVENTS,
}


@dataclass
class Healed:
    """What a run left in the ledger, as read back from it; nothing but reports and alerts without drift."""

    triggered: bool
    run_id: str
    ledger: Ledger
    alerts: DataFrame
    decisions: DataFrame | None = None
    rollbacks: DataFrame | None = None
    sizes: dict[str, int] | None = None
    trained: Trained | None = None
    reference: DataFrame | None = None
    run: DataFrame | None = None
    saved: DataFrame | None = None
    state: DataFrame | None = None


def compare_and_assign(champions: DataFrame, challengers: DataFrame, task_type: str,
                       metric: str | None = None) -> DataFrame:
    """Decision of a retrain: the role the new model gets."""
    return R.promote_decision(champions, challengers, task_type, metric)


def metrics_map(metrics: DataFrame) -> DataFrame:
    """One metrics row as a map column; counts are not metrics."""
    names = [c for c in metrics.columns if c != "n"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return metrics.select(F.create_map(*pairs).alias("metrics"))


def registry_events(ledger: Ledger, base: DataFrame | None = None, without: str | None = None) -> DataFrame:
    """Base events and those of all runs (but one, if given)."""
    events = ledger.rows("rollbacks").unionByName(ledger.rows("saves"))
    if without is not None:
        events = events.filter(F.col(RUN) != without)
    events = events.drop(RUN)
    return events if base is None else base.select(*(F.col(f.name).cast(f.dataType) for f in events.schema)).unionByName(events)


def rollback_events(events: DataFrame, model_id: str, now: str) -> DataFrame:
    """One rollback for every challenger of the model that is in service, numbered after all events."""
    standing = registry_state(events).filter((F.col("model_id") == model_id) & (F.col("stage") == "challenger"))
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("version"))
    return standing.select(
        (last + place).alias("seq"), F.lit(now).cast("timestamp").alias("at"), "model_id", "version", F.lit("rollback").alias("action"),
        F.lit(None).cast("string").alias("stage"), "uri", "framework", "metrics",
    )


def self_heal(reference: DataFrame, logs: DataFrame, model: ModelConfig, width: int,
              baseline: DataFrame | None = None, min_samples: int = 100, now: str = "2024-02-01 00:00:00",
              iterations: int = 200, root: str | None = None, registry: DataFrame | None = None,
              run_id: str | None = None) -> Healed:
    """Run the chain for one model; nothing after the alert step runs without drift.

    Export falls back to the baseline when there are no labelled logs. `root` is the ledger's folder (a fresh one in
    the shared folder by default) and `registry` the registry's events so far. The model file lies under `root` too.
    """
    spark = logs.sparkSession
    run_id = run_id or re.sub(r"[^A-Za-z0-9.-]", "-", f"{model.model_id}-{now}")
    ledger = Ledger(spark, root or scratch_path(spark, "self-healing"), LOGS)
    at = F.lit(now).cast("timestamp")
    own = logs.filter(F.col("model_id") == model.model_id)

    found = drift_check(reference.filter(F.col("model_id") == model.model_id), own, [model]).withColumn("analyzed_at", at)
    reports = ledger.put("reports", run_id, found).drop(RUN)
    alerts = ledger.put("alerts", run_id, drift_alerts(reports)).drop(RUN)
    if reports.filter("drift_detected").isEmpty():
        return Healed(False, run_id, ledger, alerts)

    judged = R.rollback_decision(health(own, ["model_id", "model_version"]), ["model_id", "model_version"])
    decisions = ledger.put("decisions", run_id, judged).drop(RUN)
    before = registry_events(ledger, registry, run_id)
    rollbacks = ledger.put("rollbacks", run_id, rollback_events(before, model.model_id, now)).drop(RUN)

    exported = export_training(own, width, baseline)
    sizes = require_samples(exported, min_samples)
    features = [c for c in exported.columns if c not in ("target", "origin")]
    keyed = exported.dropna(subset=["target"]).withColumn(
        "row_key", F.md5(F.to_json(F.struct(*features, "target", "origin")))
    )
    trained = train_challenger(keyed, "row_key", features, "target", iterations)
    version = f"v{int(datetime.fromisoformat(now).replace(tzinfo=UTC).timestamp())}"
    uri = f"models/{model.model_id.replace('-', '_')}/{version}/model"
    trained.model.write().overwrite().save(f"{ledger.root}/{uri}")
    kept = trained.reference.select(F.lit(model.model_id).alias("model_id"), F.lit(version).alias("version"), "feature_name", "value")
    stored = ledger.put("references", run_id, kept).drop(RUN)

    measured = metrics_map(trained.metrics)
    text = F.create_map(F.lit("model_id"), F.lit(model.model_id), F.lit("version"), F.lit(version))
    run = ledger.put("runs", run_id, measured.select(
        F.lit(run_id).alias("run_id"), F.lit(f"{model.model_id}-production").alias("experiment_name"), F.lit("logistic").alias("model_type"),
        text.alias("params"), "metrics", F.create_map(F.lit("trigger"), F.lit("self-healing")).alias("tags"),
        at.alias("start_time"), at.alias("end_time"), F.lit(0.0).alias("duration_seconds"),
    )).drop(RUN)
    last = before.unionByName(rollbacks).agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    saved = ledger.put("saves", run_id, measured.select(
        (last + 1).alias("seq"), at.alias("at"), F.lit(model.model_id).alias("model_id"), F.lit(version).alias("version"), F.lit("save").alias("action"),
        F.lit("challenger").alias("stage"), F.lit(uri).alias("uri"), F.lit("spark").alias("framework"), "metrics",
    )).drop(RUN)
    state = registry_state(registry_events(ledger, registry))
    return Healed(True, run_id, ledger, alerts, decisions, rollbacks, sizes, trained, stored, run, saved, state)
