import pytest
from pyspark.sql import functions as F

from driftwell import config
from driftwell.operators import abtest, metrics, rules
from driftwell.operators import history as H


def test_rollback(spark):
    health = spark.createDataFrame(
        [("a", 10, 5, 100.0), ("b", 100, 15, 100.0), ("c", 100, 2, 600.0), ("d", 100, 5, 200.0), ("e", 100, 10, 500.0)],
        "model_id string, total int, errors int, avg_latency_ms double",
    )
    got = {r["model_id"]: (r["should_rollback"], r["reason"]) for r in rules.rollback_decision(health, ["model_id"]).collect()}
    assert got["a"] == (False, "Insufficient data: 10/50 requests")
    assert got["b"] == (True, "Error rate 15.00% exceeds threshold 10.00%")
    assert got["c"] == (True, "Avg latency 600.0ms exceeds threshold 500.0ms")
    assert got["d"] == (False, "Challenger is healthy")
    assert got["e"][0] is False  # limits themselves are fine


def test_confidence_anomaly(spark):
    df = spark.createDataFrame(
        [("flat", 0.9)] * 5 + [("wild", 0.9)] * 8 + [("wild", 0.1)] * 2, "model_id string, confidence double"
    )
    own = {r["model_id"]: r for r in rules.confidence_anomaly(df, ["model_id"]).collect()}
    assert own["flat"]["detail"] == "Zero variance in confidence scores" and own["flat"]["score"] == 0.0
    baseline = spark.createDataFrame([("wild", 0.9, 0.05)], "model_id string, mean double, std double")
    row = rules.confidence_anomaly(df, ["model_id"], baseline).first()
    assert row["is_anomalous"] and row["score"] == pytest.approx(16.0)
    assert row["detail"] == "20.0% of predictions exceed z-score threshold (16.00 max)"


def test_latency_and_error_rate(spark):
    logs = spark.createDataFrame([("m", float(v)) for v in range(1, 101)], "model_id string, latency_ms double")
    base = spark.createDataFrame([("m", 49.5)], "model_id string, baseline_p99 double")
    row = rules.latency_anomaly(logs, ["model_id"], base).first()
    assert row["score"] == pytest.approx(99.01) and row["is_anomalous"] and row["threshold"] == 99.0
    counts = spark.createDataFrame([("a", 100, 5), ("b", 100, 6), ("c", 0, 0)], "m string, total int, errors int")
    got = {r["m"]: r for r in rules.error_rate_anomaly(counts, ["m"]).collect()}
    assert [got[m]["is_anomalous"] for m in "abc"] == [False, True, False]
    assert got["b"]["detail"] == "6/100 errors (6.00%)" and got["c"]["detail"] == "No requests recorded"


@pytest.mark.parametrize("chunks", [1, 3])
def test_alerts_and_cooldown(spark, chunks):
    points = [("drift_score", "m1", 0.5, 0, 1), ("drift_score", "m2", 0.5, 100, 2), ("drift_score", "m1", 0.2, 130, 3),
              ("drift_score", "m1", 0.9, 300, 4), ("other", "m1", 9.0, 0, 5)]
    metrics_ = spark.createDataFrame(points, "metric string, model_id string, value double, s long, id long").selectExpr(
        "metric", "model_id", "value", "timestamp_seconds(s) AS at", "id"
    )
    fired = rules.evaluate_alerts(metrics_, config.DEFAULT_ALERT_RULES, chunks=chunks).collect()
    assert sorted((r["rule_name"], r["id"]) for r in fired) == [
        ("high_drift_score", 1), ("high_drift_score", 4), ("moderate_drift_score", 1), ("moderate_drift_score", 3),
        ("moderate_drift_score", 4),
    ]
    first = [r for r in fired if r["rule_name"] == "high_drift_score" and r["id"] == 1][0]
    assert first["message"] == (
        "[CRITICAL] high_drift_score: drift_score=0.5000 breached threshold 0.3 (gt). "
        "Data drift score exceeds critical threshold"
    )
    per_model = rules.evaluate_alerts(metrics_, config.DEFAULT_ALERT_RULES, per_model=True, chunks=chunks).collect()
    assert ("high_drift_score", 2) in {(r["rule_name"], r["id"]) for r in per_model}


def test_comparisons(spark):
    points = spark.createDataFrame([("m", "x", 1.0, 1)], "metric string, model_id string, value double, id int")
    rows = [(c, "m", 1.0, "info", c, 0.0, "") for c in ("gt", "lt", "gte", "lte", "??")]
    table = spark.createDataFrame(rows, "rule_name string, metric string, threshold double, severity string, comparison string, cooldown_seconds double, description string")
    assert sorted(r["rule_name"] for r in rules.breaches(points, table).collect()) == ["gte", "lte"]


def test_promotion_rules(spark):
    def one(task, metric, champion, challenger):
        a = spark.createDataFrame([("m", champion)], "model_id string, metrics map<string,double>")
        b = spark.createDataFrame([("m", challenger)], "model_id string, metrics map<string,double>")
        return rules.promote_decision(a, b, task, metric).first()["promote"]

    assert one("classification", None, {"f1_score": 0.8}, {"f1_score": 0.9})
    assert not one("classification", None, {"f1_score": 0.8}, {})
    assert one("classification", "accuracy", {}, {"accuracy": 0.1})
    assert one("regression", None, {"rmse": 2.0}, {"rmse": 1.0})
    assert not one("regression", None, {"rmse": 2.0}, {})
    assert one("regression", "r2", {"r2": 0.2}, {"r2": 0.3})
    assert not one("regression", "r2", {"r2": 0.2}, {})


def test_metric_gate(spark):
    runs = spark.createDataFrame([("a", {"accuracy": 0.4}), ("b", {"accuracy": 0.6, "f1": 0.1})], "run string, metrics map<string,double>")
    got = {r["run"]: r for r in rules.metric_gate(runs, {"accuracy": 0.5, "f1": 0.05}, ["run"]).collect()}
    assert got["a"]["error"] == "Validation failed: accuracy=0.4000 < threshold=0.5" and got["b"]["passed"]


def test_ab_means_and_proportions(spark):
    low, high = [0.5, 0.6, 0.5, 0.4, 0.5] * 30, [0.9, 0.95, 0.85, 0.92, 0.88] * 30
    df = spark.createDataFrame([("m", "c", v) for v in low] + [("m", "v", v) for v in high], "k string, g string, x double")
    for chunks in (1, 3):
        row = abtest.compare_means(df, ["k"], "x", F.col("g") == "c", chunks=chunks).first()
        assert row["is_significant"] and row["recommendation"] == "Strong evidence: promote variant to production."
        assert row["control_count"] == 150 and row["variant_mean"] == pytest.approx(0.9)
    reverse = abtest.compare_means(df, ["k"], "x", F.col("g") == "v").first()
    assert reverse["recommendation"] == "Strong evidence: variant is worse. Keep control."
    counts = spark.createDataFrame(
        [("a", 50, 100, 48, 100), ("b", 90, 100, 60, 100), ("z", 0, 0, 0, 0)],
        "k string, control_successes int, control_total int, variant_successes int, variant_total int",
    )
    got = {r["k"]: r for r in abtest.compare_proportions(counts, ["k"]).collect()}
    assert not got["a"]["is_significant"] and got["b"]["is_significant"] and got["z"]["p_value"] == 1.0
    assert got["b"]["recommendation"] == "Moderate evidence: variant may be worse. Keep control."


def test_classification_and_regression_metrics(spark):
    df = spark.createDataFrame([("p", 1, 1), ("p", 0, 0), ("w", 1, 0), ("w", 0, 1), ("x", 1, 1), ("x", 1, 0), ("x", 0, 0), ("x", 0, 1)], "k string, y int, p int")
    got = {r["k"]: r for r in metrics.classification_metrics(df, ["k"], "y", "p").collect()}
    assert got["p"]["f1_score"] == 1.0 and got["w"]["accuracy"] == 0.0 and got["w"]["f1_score"] == 0.0
    assert got["x"]["precision"] == got["x"]["recall"] == 0.5
    reg = spark.createDataFrame([("a", 3.0, 2.5), ("a", 0.0, 0.5), ("c", 2.0, 1.0), ("c", 2.0, 2.0)], "k string, y double, p double")
    rows = {r["k"]: r for r in metrics.regression_metrics(reg, ["k"], "y", "p").collect()}
    assert rows["a"]["rmse"] == 0.5 and rows["a"]["mape"] == pytest.approx(100 / 6)
    assert rows["c"]["r2"] == 0.0


def test_roc(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.8), ("m", 1, 0.7), ("m", 0, 0.1), ("m", 0, 0.7)], "k string, y int, s double")
    for chunks in (1, 2):
        assert metrics.roc_auc(df, ["k"], "y", "s", chunks).first()["auc"] == pytest.approx((3 + 1.5) / 6)
        curve = {r["threshold"]: (r["tpr"], r["fpr"]) for r in metrics.roc_curve(df, ["k"], "y", "s", chunks).collect()}
        assert curve[0.7] == (1.0, pytest.approx(2 / 3)) and curve[0.9] == (0.5, 0.0)


def test_registry_fold(spark):
    rows = [
        (1, 1, "m", "1", "save", None), (2, 2, "m", "2", "save", "challenger"), (3, 3, "m", "1", "stage", "champion"),
        (4, 4, "m", "2", "stage", "champion"), (5, 5, "m", "3", "save", None), (6, 6, "m", "3", "rollback", None),
        (7, 7, "n", "9", "stage", "champion"),
    ]
    events = spark.createDataFrame(rows, "seq long, at int, model_id string, version string, action string, stage string").selectExpr(
        "*", "concat('u', seq) AS uri", "'onnx' AS framework", "map('a', 1.0D) AS metrics"
    )
    state = {(r["model_id"], r["version"]): (r["stage"], r["is_active"]) for r in H.registry_state(events).collect()}
    assert state == {("m", "1"): ("retired", False), ("m", "2"): ("champion", True), ("m", "3"): ("archived", False)}


def test_jobs_and_runs(spark):
    ev = spark.createDataFrame(
        [("j1", "m", "pending", 0, 1), ("j1", "m", "running", 10, 2), ("j1", "m", "completed", 70, 3),
         ("j2", "m", "pending", 5, 1), ("j2", "m", "completed", 6, 2)],
        "job_id string, model_id string, status string, s long, seq long",
    ).selectExpr("job_id", "model_id", "status", "timestamp_seconds(s) AS at", "seq")
    jobs = {r["job_id"]: r for r in H.jobs(ev).collect()}
    assert jobs["j1"]["duration_seconds"] == 60.0 and jobs["j2"]["duration_seconds"] is None
    audit = {(r["job_id"], r["seq"]): r["legal"] for r in H.transition_audit(ev).collect()}
    assert audit == {("j1", 1): True, ("j1", 2): True, ("j1", 3): True, ("j2", 1): True, ("j2", 2): False}
    assert H.flatten_params({"a": {"b": 1, "c": {"d": "x" * 300}}, "e": None}) == {"a.b": "1", "a.c.d": "x" * 250, "e": "None"}
    runs = spark.createDataFrame([("r1", "t", {"accuracy": 0.5}, 1.0), ("r2", "t", {}, 1.0), ("r3", "t", {"accuracy": 0.9}, 1.0)],
                                 "run_id string, model_type string, metrics map<string,double>, duration_seconds double")
    assert [r["run_id"] for r in H.runs_compare(runs).collect()] == ["r3", "r1", "r2"]
    assert H.best_run(runs, ["model_type"]).first()["run_id"] == "r3"


def test_rules_are_broadcast_and_breaches_carry_no_texts(spark):
    from driftwell.operators import rules as R

    points = spark.range(100).selectExpr("'m' AS metric", "'a' AS model_id", "double(id) AS value", "timestamp_seconds(id) AS at", "id")
    rules = [("same", "m", 50.0, "info", "gt", 10.0, "high"), ("same", "m", 10.0, "critical", "lt", 10.0, "low")]
    found = R.evaluate_alerts(points, rules)
    table = spark.createDataFrame(rules, R.ALERT_RULES)
    assert "strategy=broadcast" in R.breaches(points, table)._jdf.queryExecution().optimizedPlan().toString()
    # Rules of one name share their silence; each alert has the text of its own rule.
    got = sorted((r.id, r.severity, r.message[-4:].strip()) for r in found.collect())
    assert got == [(0, "critical", "low"), *[(i, "info", "high") for i in (51, 61, 71, 81, 91)]]
