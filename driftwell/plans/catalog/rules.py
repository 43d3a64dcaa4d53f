"""Anomaly, alert, rollback, promotion and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell import config
from driftwell.operators import metrics as M
from driftwell.operators import rules as R
from driftwell.operators.ordered import percentiles
from driftwell.plans import views
from driftwell.plans.catalog.base import LOGS, query
from driftwell.plans.catalog.logs import CLASSIFY
from driftwell.plans.checks import health
from driftwell.sources.tables import table

BYMV = "model_id, model_version"


def _current(spark, d):
    return views.prediction_logs(spark, d).filter(~views.is_reference())


def _baseline(spark, d):
    return views.prediction_logs(spark, d).filter(views.is_reference())


ANOMALY = """CASE WHEN s < 1e-10 THEN 'Zero variance in confidence scores' ELSE printf('%.1f%%', ratio * 100) || ' of predictions exceed z-score threshold ('
  || printf('%.2f', max_z) || ' max)' END"""


@query("anomaly_confidence", f"""WITH {LOGS}, b AS (SELECT model_id, avg(confidence) AS m, stddev_pop(confidence) / 3 AS s FROM logs WHERE is_ref GROUP BY model_id),
z AS (SELECT model_id, s, abs(confidence - m) / s AS z FROM logs JOIN b USING (model_id) WHERE NOT is_ref),
r AS (SELECT model_id, max(s) AS s, max(z) AS max_z, avg(CASE WHEN z > 3 THEN 1.0e0 ELSE 0 END) AS ratio, count(*) AS n FROM z GROUP BY model_id)
SELECT model_id, 'prediction_anomaly' AS anomaly_type, ratio > 0.1 AS is_anomalous, round(max_z, 6) AS score, 3.0e0 AS threshold,
{ANOMALY} AS detail, n AS sample_size FROM r""")
def anomaly_confidence(spark, d):
    baseline = _baseline(spark, d).groupBy("model_id").agg(
        F.avg("confidence").alias("mean"), (F.stddev_pop("confidence") / 3).alias("std")
    )
    return R.confidence_anomaly(_current(spark, d), ["model_id"], baseline)


@query("anomaly_confidence_own", f"""WITH {LOGS}, b AS (SELECT {BYMV}, avg(latency_ms) AS m, stddev_pop(latency_ms) AS s FROM logs GROUP BY ALL),
z AS (SELECT {BYMV}, s, abs(latency_ms - m) / s AS z FROM logs JOIN b USING ({BYMV})),
r AS (SELECT {BYMV}, max(s) AS s, max(z) AS max_z, avg(CASE WHEN z > 3 THEN 1.0e0 ELSE 0 END) AS ratio, count(*) AS n FROM z GROUP BY {BYMV})
SELECT {BYMV}, 'prediction_anomaly' AS anomaly_type, ratio > 0.1 AS is_anomalous, round(max_z, 6) AS score, 3.0e0 AS threshold,
{ANOMALY} AS detail, n AS sample_size FROM r""")
def anomaly_confidence_own(spark, d):
    return R.confidence_anomaly(
        views.prediction_logs(spark, d), ["model_id", "model_version"], value="latency_ms"
    )


@query("anomaly_latency", f"""WITH {LOGS}, b AS (SELECT model_id, quantile_cont(latency_ms, 0.5) AS b FROM logs WHERE is_ref GROUP BY model_id),
c AS (SELECT model_id, quantile_cont(latency_ms, 0.99) AS p99, count(*) AS n FROM logs WHERE NOT is_ref GROUP BY model_id)
SELECT model_id, 'latency_spike' AS anomaly_type, p99 > b * 2 AS is_anomalous, round(p99, 6) AS score, round(b * 2, 6) AS threshold,
'p99=' || printf('%.1f', p99) || 'ms (' || printf('%.1f', p99 / b) || 'x baseline ' || printf('%.1f', b) || 'ms)' AS detail, n AS sample_size FROM c JOIN b USING (model_id)""")
def anomaly_latency(spark, d):
    baseline = percentiles(_baseline(spark, d), ["model_id"], "latency_ms", {"baseline_p99": 0.5})
    return R.latency_anomaly(_current(spark, d), ["model_id"], baseline)


@query("anomaly_error_rate", f"""WITH {LOGS}, c AS (SELECT {BYMV}, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS e FROM logs GROUP BY ALL)
SELECT {BYMV}, 'error_rate' AS anomaly_type, e / n > 0.2 AS is_anomalous, round(e / n, 6) AS score, 0.2e0 AS threshold,
e || '/' || n || ' errors (' || printf('%.2f%%', e / n * 100) || ')' AS detail, n AS sample_size FROM c""")
def anomaly_error_rate(spark, d):
    counts = health(views.prediction_logs(spark, d), ["model_id", "model_version"])
    return R.error_rate_anomaly(counts, ["model_id", "model_version"], 0.2)


# Metric points: every request's latency, and the hourly shift of the mean feature against the reference.
RULES = [
    *config.DEFAULT_ALERT_RULES,
    ("slow_request", "latency_ms", 100.0, "warning", "gte", 3600.0, "Request is slow"),
    ("fast_request", "latency_ms", 0.5, "info", "lt", 7200.0, "Request is suspiciously fast"),
]

METRICS = f"""WITH RECURSIVE {LOGS}, ref AS (SELECT model_id, avg(f0) AS m, stddev_pop(f0) AS s FROM logs WHERE is_ref GROUP BY model_id),
hourly AS (SELECT 'drift_score' AS metric, model_id, date_trunc('hour', created_at) AS moment, abs(avg(f0) - max(m)) / max(s) AS value, CAST(0 AS BIGINT) AS id
  FROM logs JOIN ref USING (model_id) GROUP BY model_id, date_trunc('hour', created_at)),
points AS (SELECT * FROM hourly UNION ALL SELECT 'latency_ms', model_id, created_at, latency_ms, id FROM logs),
rules(rule_name, metric, threshold, severity, comparison, cooldown, description) AS (VALUES
  ('high_drift_score', 'drift_score', 0.3e0, 'critical', 'gt', 300, 'Data drift score exceeds critical threshold'),
  ('moderate_drift_score', 'drift_score', 0.1e0, 'warning', 'gt', 120, 'Data drift score exceeds warning threshold'),
  ('slow_request', 'latency_ms', 100.0e0, 'warning', 'gte', 3600, 'Request is slow'),
  ('fast_request', 'latency_ms', 0.5e0, 'info', 'lt', 7200, 'Request is suspiciously fast')),
hits AS MATERIALIZED (SELECT p.*, r.* EXCLUDE (metric), epoch_us(moment) AS us, row_number() OVER (PARTITION BY rule_name ORDER BY moment, model_id, id) AS n
  FROM points p JOIN rules r USING (metric) WHERE CASE comparison WHEN 'lt' THEN value < threshold WHEN 'gte' THEN value >= threshold
  WHEN 'lte' THEN value <= threshold ELSE value > threshold END),
nexts AS MATERIALIZED (SELECT a.rule_name, a.n, min(b.n) AS next FROM hits a JOIN hits b
  ON a.rule_name = b.rule_name AND a.us + a.cooldown * CAST(1000000 AS BIGINT) <= b.us GROUP BY ALL),
fired(rule_name, n) AS (SELECT DISTINCT rule_name, CAST(1 AS BIGINT) FROM hits UNION ALL SELECT f.rule_name, x.next FROM fired f JOIN nexts x ON f.rule_name = x.rule_name AND f.n = x.n)"""


def metric_points(spark, d):
    log = views.prediction_logs(spark, d)
    f0 = F.col("features")[0]
    ref = log.filter(views.is_reference()).groupBy("model_id").agg(
        F.avg(f0).alias("m"), F.stddev_pop(f0).alias("s")
    )
    hourly = log.groupBy("model_id", F.date_trunc("hour", "created_at").alias("at")).agg(F.avg(f0).alias("mean"))
    shift = hourly.join(ref, "model_id").select(
        F.lit("drift_score").alias("metric"), "model_id", F.col("at").cast("timestamp").alias("at"),
        (F.abs(F.col("mean") - F.col("m")) / F.col("s")).alias("value"), F.lit(0).cast("bigint").alias("id"),
    )
    slow = log.select(
        F.lit("latency_ms").alias("metric"), "model_id", F.col("created_at").cast("timestamp").alias("at"),
        F.col("latency_ms").alias("value"), "id",
    )
    return shift.unionByName(slow)


@query("alert_evaluate", f"""{METRICS} SELECT h.rule_name, severity, 'firing' AS status, model_id, id, us AS at_us, round(value, 6) AS metric_value, threshold,
'[' || upper(severity) || '] ' || h.rule_name || ': ' || metric || '=' || printf('%.4f', value) || ' breached threshold ' || threshold
 || ' (' || comparison || '). ' || description AS message FROM fired f JOIN hits h ON f.rule_name = h.rule_name AND f.n = h.n""")
def alert_evaluate(spark, d):
    fired = R.evaluate_alerts(metric_points(spark, d), RULES)
    return fired.withColumn("at_us", F.unix_micros("at")).drop("at")


@query("rollback_decision", f"""WITH {LOGS}, h AS (SELECT model_id, entity_id % 10 AS shard, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS errors,
avg(latency_ms) * 11 AS lat FROM logs WHERE model_version = 'v2' GROUP BY ALL)
SELECT model_id, shard, total >= 50 AND (errors / total > 0.2 OR lat > 500) AS should_rollback,
CASE WHEN total < 50 THEN 'Insufficient data: ' || total || '/50 requests'
 WHEN errors / total > 0.2 THEN 'Error rate ' || printf('%.2f%%', errors / total * 100) || ' exceeds threshold 20.00%'
 WHEN lat > 500 THEN 'Avg latency ' || printf('%.1f', lat) || 'ms exceeds threshold 500.0ms' ELSE 'Challenger is healthy' END AS reason,
round(CASE WHEN total < 50 THEN 0 ELSE errors / total END, 6) AS error_rate, round(CASE WHEN total < 50 THEN 0 ELSE lat END, 6) AS avg_latency_ms FROM h""")
def rollback_decision(spark, d):
    rows = views.prediction_logs(spark, d).filter("model_version = 'v2'").withColumn("shard", F.col("entity_id") % 10)
    state = health(rows, ["model_id", "shard"]).withColumn("avg_latency_ms", F.col("avg_latency_ms") * 11)
    return R.rollback_decision(state, ["model_id", "shard"], max_error_rate=0.2)


def role_metrics(spark, d, version: str):
    """One metrics map per model for a version."""
    rows = M.classification_metrics(
        views.prediction_logs(spark, d).filter(F.col("model_version") == version), ["model_id"]
    )
    names = ["accuracy", "precision", "recall", "f1_score"]
    return rows.select("model_id", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("metrics"))


SCORES = f"""WITH {LOGS}, c AS ({CLASSIFY}),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c),
s AS (SELECT model_id, model_version, accuracy, p AS precision, q AS recall, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1_score FROM r),
a AS (SELECT * FROM s WHERE model_version = 'v1'), b AS (SELECT * FROM s WHERE model_version = 'v2')"""


@query("promote_decision", f"""{SCORES} SELECT model_id, 'f1_score' AS metric, round(a.f1_score, 6) AS champion_value, round(b.f1_score, 6) AS challenger_value,
b.f1_score > a.f1_score AS promote, CASE WHEN b.f1_score > a.f1_score THEN 'champion' ELSE 'challenger' END AS role FROM a JOIN b USING (model_id)""")
def promote_decision(spark, d):
    return R.promote_decision(role_metrics(spark, d, "v1"), role_metrics(spark, d, "v2"))


REGRESSION = """WITH t AS (SELECT 'model-' || l_returnflag AS model_id, l_linestatus AS s, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem),
m AS (SELECT model_id, s, sqrt(avg((y - p) * (y - p))) AS rmse FROM t GROUP BY ALL)"""


@query("promote_decision_regression", f"""{REGRESSION} SELECT model_id, 'rmse' AS metric, round(a.rmse, 4) AS champion_value, round(b.rmse, 4) AS challenger_value,
b.rmse < a.rmse AS promote, CASE WHEN b.rmse < a.rmse THEN 'champion' ELSE 'challenger' END AS role
FROM (SELECT * FROM m WHERE s = 'F') a JOIN (SELECT * FROM m WHERE s = 'O') b USING (model_id)""", 4)
def promote_decision_regression(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("model-"), "l_returnflag").alias("model_id"), "l_linestatus", "l_extendedprice",
        (F.col("l_quantity") * 1000).alias("guess"),
    )
    scores = M.regression_metrics(li, ["model_id", "l_linestatus"], "l_extendedprice", "guess").select(
        "model_id", "l_linestatus", F.create_map(F.lit("rmse"), "rmse", F.lit("r2"), "r2").alias("metrics")
    )
    return R.promote_decision(
        scores.filter("l_linestatus = 'F'"), scores.filter("l_linestatus = 'O'"), "regression"
    )


@query("model_comparison", f"""{SCORES}, la AS (UNPIVOT (SELECT model_id, accuracy, precision, recall, f1_score FROM a) ON accuracy, precision, recall, f1_score INTO NAME metric VALUE champion),
lb AS (UNPIVOT (SELECT model_id, accuracy, precision, recall, f1_score FROM b) ON accuracy, precision, recall, f1_score INTO NAME metric VALUE challenger)
SELECT model_id, metric, round(champion, 6) AS champion, round(challenger, 6) AS challenger, round(challenger - champion, 6) + 0 AS delta
FROM la FULL JOIN lb USING (model_id, metric)""")
def model_comparison(spark, d):
    return R.model_comparison(role_metrics(spark, d, "v1"), role_metrics(spark, d, "v2"))


@query("metric_gate", """WITH r AS (SELECT 'run-' || o_orderkey AS run_id,
 CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice / 1e6 END AS accuracy,
 CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 1 - o_totalprice / 1e6 END AS loss FROM orders)
SELECT run_id, NOT (accuracy < 0.25 OR loss < 0.6) AS passed, CASE WHEN accuracy < 0.25 THEN 'Validation failed: accuracy=' || printf('%.4f', accuracy) || ' < threshold=0.25'
 WHEN loss < 0.6 THEN 'Validation failed: loss=' || printf('%.4f', loss) || ' < threshold=0.6' END AS error FROM r""")
def metric_gate(spark, d):
    from driftwell.operators.history import runs_log

    return R.metric_gate(runs_log(views.runs(spark, d)), {"accuracy": 0.25, "loss": 0.6}, ["run_id"])


@query("retrain_compare", f"""{SCORES} SELECT model_id, 'accuracy' AS metric, round(a.accuracy, 6) AS champion_value, round(b.accuracy, 6) AS challenger_value,
b.accuracy > a.accuracy AS promote, CASE WHEN b.accuracy > a.accuracy THEN 'champion' ELSE 'challenger' END AS role FROM a JOIN b USING (model_id)""")
def retrain_compare(spark, d):
    from driftwell.plans.healing import compare_and_assign

    return compare_and_assign(
        role_metrics(spark, d, "v1"), role_metrics(spark, d, "v2"), "classification", "accuracy"
    )
