import pytest
from pyspark.sql import functions as F

from driftwell.operators.history import registry_state
from driftwell.plans import healing, views
from driftwell.plans.checks import ModelConfig, drift_check
from driftwell.plans.ledger import Ledger
from driftwell.session import scratch_path

FEATURES = ["feature_0", "feature_1", "feature_2"]


def reference(spark, tiny, factor):
    logs = views.prediction_logs(spark, tiny)
    rows = logs.select("model_id", F.posexplode("features").alias("i", "value"))
    return rows.select("model_id", F.concat(F.lit("feature_"), "i").alias("feature_name"), (F.col("value") * factor).alias("value"))


def registry(spark):
    rows = [(1, "m1", "1.0", "save", "challenger"), (2, "m1", "1.0", "stage", "champion"), (3, "m1", "1.1", "save", "challenger"), (4, "m2", "9.0", "save", "challenger"),
            (5, "m1", "1.2", "save", "challenger"), (6, "m1", "1.2", "rollback", None)]
    events = spark.createDataFrame(rows, "seq long, model_id string, version string, action string, stage string")
    return events.select("seq", F.timestamp_seconds("seq").alias("at"), "model_id", "version", "action", "stage", F.concat(F.lit("models/"), "seq").alias("uri"),
                         F.lit("spark").alias("framework"), F.create_map(F.lit("accuracy"), F.lit(0.5)).alias("metrics"))


def heal(spark, tiny, root, factor=3.0, **more):
    return healing.self_heal(reference(spark, tiny, factor), views.prediction_logs(spark, tiny), ModelConfig("m1"), 3, min_samples=10,
                             iterations=5, root=root, registry=registry(spark), **more)


def test_a_run_acts_and_is_read_back(spark, tiny):
    root = scratch_path(spark, "heal")
    healed = heal(spark, tiny, root)
    assert healed.triggered and healed.alerts.count() == 2
    assert [(r.seq, r.version) for r in healed.rollbacks.collect()] == [(7, "1.1")]
    saved = healed.saved.first()
    assert (saved.seq, saved.version, saved.stage, saved.uri) == (8, "v1706745600", "challenger", "models/m1/v1706745600/model")
    stages = {(r.model_id, r.version): r.stage for r in healed.state.collect()}
    assert stages == {("m1", "1.0"): "champion", ("m1", "1.1"): "archived", ("m1", "1.2"): "archived", ("m1", "v1706745600"): "challenger", ("m2", "9.0"): "challenger"}
    assert healed.run.first().metrics.keys() == saved.metrics.keys() and "accuracy" in saved.metrics
    assert spark.read.parquet(f"{root}/{saved.uri}/data").count() == 1


def test_a_rerun_replaces_its_own_rows(spark, tiny):
    root = scratch_path(spark, "heal")
    first = heal(spark, tiny, root)
    kept = {log: sorted(map(str, first.ledger.rows(log).collect())) for log in healing.LOGS}
    again = heal(spark, tiny, root)
    assert {log: sorted(map(str, again.ledger.rows(log).collect())) for log in healing.LOGS} == kept
    assert sorted(map(str, again.state.collect())) == sorted(map(str, registry_state(healing.registry_events(again.ledger, registry(spark))).collect()))


def test_a_later_run_archives_the_earlier_challenger(spark, tiny):
    root = scratch_path(spark, "heal")
    heal(spark, tiny, root)
    later = heal(spark, tiny, root, now="2024-02-02 00:00:00")
    assert [(r.seq, r.version) for r in later.rollbacks.collect()] == [(9, "v1706745600")]
    assert later.saved.first().seq == 10 and later.ledger.rows("runs").count() == 2
    stages = {r.version: r.stage for r in later.state.filter("model_id = 'm1'").collect()}
    assert stages["v1706745600"] == "archived" and stages["v1706832000"] == "challenger" and stages["1.0"] == "champion"


def test_without_drift_only_the_check_is_logged(spark, tiny):
    healed = heal(spark, tiny, scratch_path(spark, "heal"), 1.0)
    assert not healed.triggered and healed.alerts.count() == 0 and healed.state is None
    assert healed.ledger.rows("reports").count() == 3
    assert all(healed.ledger.rows(log).count() == 0 for log in ("decisions", "rollbacks", "runs", "saves", "references"))


def test_the_stored_reference_serves_the_next_check(spark, tiny):
    """What training leaves is a reference: the logs it came from have not drifted from it, moved ones have."""
    healed = heal(spark, tiny, scratch_path(spark, "heal"))
    assert {r.feature_name for r in healed.reference.select("feature_name").distinct().collect()} == set(FEATURES)
    logs = views.prediction_logs(spark, tiny).filter("model_id = 'm1' AND ground_truth IS NOT NULL")
    assert not any(r.drift_detected for r in drift_check(healed.reference, logs, [ModelConfig("m1")]).collect())
    moved = logs.withColumn("features", F.transform("features", lambda x: x * 5 + 40))
    assert all(r.drift_detected for r in drift_check(healed.reference, moved, [ModelConfig("m1")]).collect())


def test_too_few_samples_stop_the_run_after_the_rollback(spark, tiny):
    root = scratch_path(spark, "heal")
    with pytest.raises(ValueError, match="Insufficient data"):
        healing.self_heal(reference(spark, tiny, 3.0), views.prediction_logs(spark, tiny), ModelConfig("m1"), 3, min_samples=10**6, root=root, registry=registry(spark))
    assert Ledger(spark, root, healing.LOGS).rows("rollbacks").count() == 1
    healed = heal(spark, tiny, root)
    assert healed.ledger.rows("rollbacks").count() == 1 and healed.saved.first().seq == 8
