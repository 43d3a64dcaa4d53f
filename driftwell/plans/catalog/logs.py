"""Log queries, request validation, aggregates and A/B tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.math import chi2_cdf1, norm_cdf
from driftwell.operators import abtest, logs, metrics
from driftwell.operators.scoring import route_ab, score_batch, mean_score
from driftwell.plans import views
from driftwell.plans.catalog.base import LOGS, ecdf_sql, erf_sql, query, bucket_sql
from driftwell.plans.checks import health
from driftwell.sources.tables import append_logs, table
from driftwell.session import scratch_path

NEWEST = "row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, id DESC)"


@query("recent_logs", f"""WITH {LOGS} SELECT id, model_id, model_version, latency_ms, created_at FROM logs
QUALIFY {NEWEST} <= 1000""")
def recent_logs(spark, d):
    return logs.recent_logs(views.prediction_logs(spark, d)).select(
        "id", "model_id", "model_version", "latency_ms", "created_at"
    )


@query("recent_logs_one_model", f"""WITH {LOGS} SELECT id, model_id, latency_ms FROM logs WHERE model_id = 'm1'
ORDER BY created_at DESC, id DESC LIMIT 1000""")
def recent_logs_one(spark, d):
    return logs.recent_logs(views.prediction_logs(spark, d), model_id="m1").select("id", "model_id", "latency_ms")


@query("prediction_log_view", f"""WITH {LOGS} SELECT id, model_id, model_version AS version, result,
round(confidence, 6) AS confidence, latency_ms FROM logs QUALIFY {NEWEST} <= 100""")
def prediction_log_view(spark, d):
    return logs.prediction_log_view(views.prediction_logs(spark, d))


@query("labeled_logs", f"""WITH {LOGS} SELECT id, model_id, f0, f1, f2, ground_truth AS target, result AS prediction,
round(confidence, 6) AS confidence, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
FROM logs WHERE ground_truth IS NOT NULL QUALIFY {NEWEST} <= 10000""")
def labeled_logs(spark, d):
    rows = logs.labeled_logs(views.prediction_logs(spark, d))
    return rows.select(
        "id", "model_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)], "target", "prediction",
        "confidence", "created_at",
    )


@query("attach_feedback", f"""WITH {LOGS}, feedback AS (
  SELECT id - CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS id, CAST(k % 2 AS DOUBLE) AS given, created_at AS seen_at
  FROM logs WHERE event_type IN ('purchase', 'click')),
latest AS (SELECT id, arg_max(given, seen_at) AS given FROM feedback GROUP BY id)
SELECT l.id, l.model_id, coalesce(f.given, l.ground_truth) AS ground_truth
FROM logs l LEFT JOIN latest f ON l.id = f.id""")
def attach_feedback(spark, d):
    log = views.prediction_logs(spark, d)
    e = views.events(spark, d).filter(F.col("event_type").isin("purchase", "click"))
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    feedback = e.select(
        (F.col("event_id") - F.when(F.col("event_type") == "purchase", 1).otherwise(2)).alias("id"),
        (k % 2).cast("double").alias("ground_truth"), F.col("ts").alias("received_at"),
    )
    return logs.attach_feedback(log, feedback).select("id", "model_id", "ground_truth")


@query("extract_feature", f"""WITH {LOGS} SELECT id, model_id, 'feature_0' AS feature_name, f0 AS value FROM logs
UNION ALL SELECT id, model_id, 'feature_1', f1 FROM logs UNION ALL SELECT id, model_id, 'feature_2', f2 FROM logs""")
def extract_feature(spark, d):
    return views.prediction_logs(spark, d).select(
        "id", "model_id", F.posexplode("features").alias("p", "value")
    ).select("id", "model_id", F.concat(F.lit("feature_"), "p").alias("feature_name"), "value")


@query("validate_request_rows", f"""WITH {LOGS}, vec AS (
  SELECT id, model_id, CASE WHEN id % 19 = 0 THEN CAST([] AS DOUBLE[]) WHEN id % 17 = 0 THEN [f0, f1]
    WHEN id % 13 = 0 THEN [f0, CAST('nan' AS DOUBLE), f2] WHEN id % 11 = 0 THEN [f0, f1, CAST('inf' AS DOUBLE)]
    ELSE [f0, f1, f2] END AS f FROM logs),
found AS (SELECT id, CASE WHEN len(f) = 0 THEN ['Features list cannot be empty'] ELSE list_filter([
    CASE WHEN len(f) <> 3 THEN 'Feature count mismatch: got ' || len(f) || ', expected 3 for model ' || model_id END,
    CASE WHEN len(f) <> 3 THEN 'Feature count doesn''t match model schema: got ' || len(f) || ', schema has 3 features' END,
    CASE WHEN (f[1] < 0.5 OR f[1] > 200) AND NOT isnan(f[1]) THEN 'Feature ''f0'' value ' || f[1] || ' out of range [0.5, 200.0]' END,
    CASE WHEN (f[2] < 0 OR f[2] > 95) AND NOT isnan(f[2]) THEN 'Feature ''f1'' value ' || f[2] || ' out of range [0.0, 95.0]' END,
    CASE WHEN isnan(f[2]) THEN 'Feature at index 1 is NaN' END,
    CASE WHEN isinf(f[3]) THEN 'Feature at index 2 is infinite' END], lambda e: e IS NOT NULL) END AS errors FROM vec)
SELECT id, CAST(len(errors) AS INTEGER) AS n_errors, array_to_string(errors, '; ') AS errors FROM found""")
def validate_request_rows(spark, d):
    f = F.col("features")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    broken = (
        F.when(F.col("id") % 19 == 0, F.array().cast("array<double>"))
        .when(F.col("id") % 17 == 0, F.array(f[0], f[1]))
        .when(F.col("id") % 13 == 0, F.array(f[0], nan, f[2]))
        .when(F.col("id") % 11 == 0, F.array(f[0], f[1], inf))
        .otherwise(f)
    )
    errors = logs.request_errors(
        "features", "model_id", 3, ["f0", "f1", "f2"], {"f0": (0.5, 200.0), "f1": (0.0, 95.0)}
    )
    rows = views.prediction_logs(spark, d).withColumn("features", broken).select("id", errors.alias("e"))
    return rows.select("id", F.size("e").alias("n_errors"), F.concat_ws("; ", "e").alias("errors"))


@query("validate_prediction_request", f"""WITH {LOGS} SELECT id, CASE WHEN id % 23 = 0 THEN 'model_id is required'
WHEN id % 7 = 0 AND event_type = 'view' THEN 'Either features or entity_id must be provided' END AS error FROM logs""")
def validate_prediction_request(spark, d):
    e = views.events(spark, d).select("event_id", "event_type")
    rows = views.prediction_logs(spark, d).join(e, F.col("id") == F.col("event_id")).withColumns(
        {
            "model_id": F.when(F.col("id") % 23 != 0, F.col("model_id")),
            "features": F.when(F.col("id") % 7 != 0, F.col("features")),
            "entity_id": F.when(F.col("event_type") != "view", F.col("entity_id")),
        }
    )
    return rows.select("id", logs.missing_inputs().alias("error"))


@query("confident_predictions", f"""WITH {LOGS} SELECT id, model_id, round(confidence, 6) AS confidence FROM logs
WHERE confidence >= 0.9""")
def confident_predictions(spark, d):
    return logs.confident(views.prediction_logs(spark, d), 0.9).select("id", "model_id", "confidence")


@query("latency_budget", f"""WITH {LOGS} SELECT model_id, model_version, count(*) AS requests,
count(*) FILTER (WHERE latency_ms > 100) AS violations,
round(avg(CASE WHEN latency_ms > 100 THEN 1.0e0 ELSE 0 END), 6) AS violation_rate FROM logs GROUP BY ALL""")
def latency_budget(spark, d):
    return logs.budget_violations(views.prediction_logs(spark, d), 100.0, ["model_id", "model_version"])


VERSIONS = """versions AS (SELECT 'model-' || CAST(o_custkey % 200 AS VARCHAR) AS model_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'v' || o_orderkey ELSE '1.' || (o_orderkey % 13) || '.' || (o_custkey % 11) END AS version
  FROM orders)"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(
        F.lit("1."), (F.col("o_orderkey") % 13).cast("string"), F.lit("."), (F.col("o_custkey") % 11).cast("string")
    )
    return o.select(
        F.concat(F.lit("model-"), (F.col("o_custkey") % 200).cast("string")).alias("model_id"),
        F.when(F.col("o_orderkey") % 29 == 0, F.concat(F.lit("v"), F.col("o_orderkey").cast("string")))
        .otherwise(text).alias("version"),
    )


@query("latest_model_version", f"""WITH {VERSIONS} SELECT model_id, version AS latest_version FROM versions
WHERE regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+')
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY CAST(split_part(version, '.', 1) AS INT) DESC,
 CAST(split_part(version, '.', 2) AS INT) DESC, CAST(split_part(version, '.', 3) AS INT) DESC) = 1""")
def latest_model_version(spark, d):
    return logs.latest_version(_versions(spark, d), ["model_id"])


@query("rejected_model_versions", f"""WITH {VERSIONS} SELECT model_id, version FROM versions
WHERE NOT regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+')""")
def rejected_model_versions(spark, d):
    return logs.rejected_versions(_versions(spark, d))


@query("cast_features", f"""WITH {LOGS} SELECT id, CAST(k AS DOUBLE) AS raw, false AS rejected FROM logs WHERE id % 9 <> 0
UNION ALL SELECT id, NULL, true FROM logs WHERE id % 9 = 0""")
def cast_features(spark, d):
    e = views.events(spark, d)
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    raw = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(k).alias("raw"))
    good = logs.cast_features(raw, ["raw"]).withColumn("rejected", F.lit(False))
    bad = logs.cast_features(raw, ["raw"], reject=True).select(
        "id", F.lit(None).cast("double").alias("raw"), F.lit(True).alias("rejected")
    )
    return good.unionByName(bad)


@query("rolling_request_flags", f"""WITH {LOGS} SELECT id, model_id,
count(*) OVER (PARTITION BY model_id ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS requests_in_window,
count(*) OVER (PARTITION BY model_id ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 6 AS limited
FROM logs""")
def rolling_request_flags(spark, d):
    return logs.rolling_request_flags(views.prediction_logs(spark, d), "model_id", 6, 3600)


@query("sink_prediction_log", f"""WITH {LOGS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, model_id,
count(*) AS predictions, round(sum(latency_ms), 4) AS latency FROM logs GROUP BY ALL""", 4)
def sink_prediction_log(spark, d):
    path = scratch_path(spark, "prediction_logs")
    append_logs(views.prediction_logs(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("day").cast("string").alias("day"), "model_id").agg(
        F.count("*").alias("predictions"), F.sum("latency_ms").alias("latency")
    )


# Aggregates ---------------------------------------------------------------

@query("model_performance", f"""WITH {LOGS}, recent AS (SELECT * FROM logs)
SELECT model_id, count(*) AS total_predictions, round(avg(latency_ms), 2) AS avg_latency_ms,
round(avg(confidence), 4) AS avg_confidence FROM recent GROUP BY model_id""")
def model_performance(spark, d):
    return metrics.model_performance(views.prediction_logs(spark, d))


CLASSIFY = """SELECT model_id, model_version, count(*) AS n, avg(CASE WHEN ground_truth = result THEN 1.0e0 ELSE 0 END) AS accuracy,
  count(*) FILTER (WHERE ground_truth = 1 AND result = 1) AS tp, count(*) FILTER (WHERE ground_truth = 0 AND result = 1) AS fp,
  count(*) FILTER (WHERE ground_truth = 1 AND result = 0) AS fn FROM logs WHERE ground_truth IS NOT NULL GROUP BY ALL"""


@query("classification_metrics", f"""WITH {LOGS}, c AS ({CLASSIFY}),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
SELECT model_id, model_version, n, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall,
round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1_score FROM r""")
def classification_metrics(spark, d):
    return metrics.classification_metrics(views.prediction_logs(spark, d), ["model_id", "model_version"])


MEASURES = {
    "m0": {"cost": lambda y, p: F.sum(F.when(y > p, 5.0).when(y < p, 1.0).otherwise(0.0)), "hits": lambda y, p: F.count_if(y == p)},
    "*": {"bias": lambda y, p: F.avg(p - y)},
}


@query("custom_metrics", f"""WITH {LOGS}, y AS (SELECT * FROM logs WHERE ground_truth IS NOT NULL AND result IS NOT NULL)
SELECT model_id, 'cost' AS metric, sum(CASE WHEN ground_truth > result THEN 5.0e0 WHEN ground_truth < result THEN 1.0e0 ELSE 0.0e0 END) AS value, count(*) AS n FROM y WHERE model_id = 'm0' GROUP BY model_id
UNION ALL SELECT model_id, 'hits', CAST(count(*) FILTER (WHERE ground_truth = result) AS DOUBLE), count(*) FROM y WHERE model_id = 'm0' GROUP BY model_id
UNION ALL SELECT model_id, 'bias', round(avg(result - ground_truth), 6), count(*) FROM y WHERE model_id <> 'm0' GROUP BY model_id""")
def custom_metrics(spark, d):
    return metrics.custom_metrics(views.prediction_logs(spark, d), MEASURES)


@query("regression_metrics", """WITH t AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem),
m AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS my FROM t)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 4) AS r2,
round(avg(abs((y - p) / nullif(y, 0))) * 100, 4) AS mape FROM m GROUP BY l_returnflag""", 4)
def regression_metrics(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1000).alias("guess")
    )
    return metrics.regression_metrics(li, ["l_returnflag"], "l_extendedprice", "guess")


MULTI = """t AS (SELECT model_id, event_type AS y,
  CASE k % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' WHEN 4 THEN 'signup' ELSE event_type END AS p FROM logs)"""


def _multiclass(spark, d):
    e = views.events(spark, d)
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int") % 6
    guess = F.col("event_type")
    for i, name in enumerate(["view", "click", "purchase", "error", "signup"]):
        guess = F.when(k == i, F.lit(name)).otherwise(guess)
    return e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.col("event_type").alias("y"), guess.alias("p"),
    )


@query("multiclass_report", f"""WITH {LOGS}, {MULTI},
labels_ AS (SELECT model_id, y AS label FROM t UNION SELECT model_id, p FROM t),
c AS (SELECT l.model_id, l.label, count(*) FILTER (WHERE t.y = l.label AND t.p = l.label) AS tp,
  count(*) FILTER (WHERE t.y = l.label) AS support, count(*) FILTER (WHERE t.p = l.label) AS predicted
  FROM labels_ l JOIN t ON l.model_id = t.model_id GROUP BY ALL),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM c),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM r)
SELECT model_id, label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support,
round(avg(f1) OVER (PARTITION BY model_id), 6) AS f1_macro,
round(sum(f1 * support) OVER (PARTITION BY model_id) / sum(support) OVER (PARTITION BY model_id), 6) AS f1_weighted FROM f""")
def multiclass_report(spark, d):
    return metrics.multiclass_report(_multiclass(spark, d), ["model_id"], "y", "p")


@query("confusion_matrix", f"""WITH {LOGS}, {MULTI} SELECT model_id, y AS y_true, p AS y_pred, count(*) AS n FROM t GROUP BY ALL""")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_multiclass(spark, d), ["model_id"], "y", "p")


LABELLED = "lab AS (SELECT model_id, confidence AS value, ground_truth = 1 AS is_ref FROM logs WHERE ground_truth IS NOT NULL)"


@query("roc_auc", f"""WITH {LOGS}, {LABELLED}, {ecdf_sql("lab", ["model_id"])}
SELECT model_id, CAST(max(ta) AS BIGINT) AS positives, CAST(max(tb) AS BIGINT) AS negatives,
round((sum(a * (ca + cb - a - b + (a + b + 1) / 2)) - max(ta) * (max(ta) + 1) / 2) / (max(ta) * max(tb)), 6) AS auc
FROM ecdf GROUP BY model_id""")
def roc_auc(spark, d):
    return metrics.roc_auc(views.prediction_logs(spark, d), ["model_id"], "ground_truth", "confidence")


@query("roc_curve", f"""WITH {LOGS}, {LABELLED}, {ecdf_sql("lab", ["model_id"])}
SELECT model_id, round(v, 6) AS threshold, round((ta - ca + a) / ta, 6) AS tpr, round((tb - cb + b) / tb, 6) AS fpr FROM ecdf""")
def roc_curve(spark, d):
    return metrics.roc_curve(views.prediction_logs(spark, d), ["model_id"], "ground_truth", "confidence")


@query("latency_summary", f"""WITH {LOGS} SELECT model_id, count(*) AS requests, round(min(latency_ms), 2) AS min,
round(quantile_cont(latency_ms, 0.5), 2) AS p50, round(quantile_cont(latency_ms, 0.95), 2) AS p95,
round(quantile_cont(latency_ms, 0.99), 2) AS p99, round(max(latency_ms), 2) AS max, round(avg(latency_ms), 2) AS mean,
round(stddev_pop(latency_ms), 2) AS std,
round(count(*) / ((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6), 6) AS rps FROM logs GROUP BY model_id""")
def latency_summary(spark, d):
    return metrics.latency_summary(views.prediction_logs(spark, d), ["model_id"])


@query("class_balance", f"""WITH {LOGS} SELECT model_id, count(*) FILTER (WHERE event_type <> 'error') AS n_neg,
count(*) FILTER (WHERE event_type = 'error') AS n_pos,
round(count(*) FILTER (WHERE event_type <> 'error') / greatest(count(*) FILTER (WHERE event_type = 'error'), 1), 6) AS pos_weight
FROM logs GROUP BY model_id""")
def class_balance(spark, d):
    rows = views.prediction_logs(spark, d).withColumn("target", (F.col("status") == "error").cast("int"))
    return metrics.class_balance(rows, "target", ["model_id"])


ROUTED = f"""routed AS (SELECT *, CASE WHEN {bucket_sql("entity_id", "ab")} < 3000 THEN 'challenger' ELSE 'champion' END AS role FROM logs)"""


def registry_of_two(spark, d):
    """Both versions of every model seen in the log, v1 first and champion."""
    seen = views.prediction_logs(spark, d).groupBy("model_id", F.col("model_version").alias("version")).agg(
        F.min("created_at").alias("_seen")
    )
    return seen.select(
        "model_id", "version",
        F.when(F.col("version") == "v1", F.lit("champion")).otherwise(F.lit("challenger")).alias("stage"),
        F.lit(True).alias("is_active"),
        F.when(F.col("version") == "v1", F.lit(1)).otherwise(F.lit(2)).alias("created_at"),
    )


@query("traffic_split", f"""WITH {LOGS}, {ROUTED}, c AS (SELECT model_id, role, count(*) AS requests FROM routed GROUP BY ALL)
SELECT model_id, role, requests, round(requests / sum(requests) OVER (PARTITION BY model_id), 6) AS share FROM c""")
def traffic_split(spark, d):
    assigned = route_ab(views.prediction_logs(spark, d), registry_of_two(spark, d), 0.3)
    return metrics.traffic_split(assigned, ["model_id"])


@query("label_rate", f"""WITH {LOGS} SELECT model_id, count(*) AS total, count(ground_truth) AS labelled,
round(count(ground_truth) * 100.0e0 / count(*), 6) AS label_rate FROM logs GROUP BY model_id""")
def label_rate(spark, d):
    return metrics.label_rate(views.prediction_logs(spark, d), ["model_id"])


def _scored_batch(spark, d):
    rows = views.prediction_logs(spark, d).withColumn("batch", F.to_date("created_at").cast("string"))
    scored = score_batch(rows, mean_score, F.lit(0.99))
    bad = F.when(F.col("status") == "error", F.concat(F.lit("request failed: "), F.col("model_version")))
    return scored.withColumn("error", bad)


@query("batch_summary", f"""WITH {LOGS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS batch, count(*) AS total,
count(*) FILTER (WHERE status <> 'error') AS successful, count(*) FILTER (WHERE status = 'error') AS failed FROM logs GROUP BY ALL""")
def batch_summary(spark, d):
    return metrics.batch_summary(_scored_batch(spark, d), ["batch"])


@query("batch_errors", f"""WITH {LOGS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS batch, id AS index,
'request failed: ' || model_version AS error FROM logs WHERE status = 'error'""")
def batch_errors(spark, d):
    return metrics.batch_errors(_scored_batch(spark, d), ["batch"], "id")


@query("prediction_counter", f"""WITH {LOGS} SELECT model_id, model_version, count(*) FILTER (WHERE status = 'success') AS success_count,
count(*) FILTER (WHERE status <> 'success') AS error_count,
round(avg(confidence) FILTER (WHERE status = 'success'), 6) AS success_confidence FROM logs GROUP BY ALL""")
def prediction_counter(spark, d):
    return metrics.prediction_counter(views.prediction_logs(spark, d), ["model_id", "model_version"])


# A/B ----------------------------------------------------------------------

def ab_advice_sql(p: str, better: str, effect: str) -> str:
    return f"""CASE WHEN NOT ({p} < 0.05) THEN 'No significant difference. Continue testing or keep control.'
  WHEN {effect} < 0.2 THEN 'Statistically significant but negligible effect. Keep control.'
  WHEN {better} AND {effect} > 0.8 THEN 'Strong evidence: promote variant to production.'
  WHEN {better} THEN 'Moderate evidence: consider promoting variant.'
  WHEN {effect} > 0.8 THEN 'Strong evidence: variant is worse. Keep control.'
  ELSE 'Moderate evidence: variant may be worse. Keep control.' END"""


def means_sql(rows: str) -> str:
    """`rows` has model_id, value, is_ref (control)."""
    return f"""{rows}, {ecdf_sql("ab", ["model_id"])},
u AS (SELECT model_id, max(ta) AS n1, max(tb) AS n2,
  sum(a * (ca + cb - a - b + (a + b + 1) / 2)) - max(ta) * (max(ta) + 1) / 2 AS u FROM ecdf GROUP BY model_id),
m AS (SELECT model_id, avg(value) FILTER (WHERE is_ref) AS m1, avg(value) FILTER (WHERE NOT is_ref) AS m2,
  stddev_samp(value) FILTER (WHERE is_ref) AS s1, stddev_samp(value) FILTER (WHERE NOT is_ref) AS s2 FROM ab GROUP BY model_id),
z AS (SELECT *, abs(u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z,
  abs(m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2) AS effect FROM u JOIN m USING (model_id)),
r AS (SELECT *, 2 * (1 - 0.5e0 * (1 + {erf_sql("(z / sqrt(2.0e0))")})) AS p FROM z)"""


MEANS = means_sql("ab AS (SELECT model_id, latency_ms AS value, model_version = 'v1' AS is_ref FROM logs)")
SHIFTED = means_sql("""ab AS (SELECT model_id, value, is_ref FROM (
  SELECT model_id, confidence + CASE WHEN model_version = 'v2' THEN 0.05e0 + 0.1e0 * CAST(substr(model_id, 2) AS INT) ELSE 0 END AS value,
  model_version = 'v1' AS is_ref FROM logs) x)""")


@query("ab_means", f"""WITH {LOGS}, {MEANS} SELECT model_id, round(m1, 6) AS control_mean, round(m2, 6) AS variant_mean,
CAST(n1 AS BIGINT) AS control_count, CAST(n2 AS BIGINT) AS variant_count, round(z, 6) AS statistic, round(p, 6) AS p_value,
p < 0.05 AS is_significant, round(effect, 6) AS effect_size, 0.95e0 AS confidence_level,
{ab_advice_sql("p", "m2 > m1", "effect")} AS recommendation, 'mann_whitney_u' AS test_method FROM r""")
def ab_means(spark, d):
    return abtest.compare_means(
        views.prediction_logs(spark, d), ["model_id"], "latency_ms", F.col("model_version") == "v1"
    )


PROPORTIONS = f"""p AS (SELECT model_id, count(*) FILTER (WHERE model_version = 'v1') AS n1, count(*) FILTER (WHERE model_version = 'v2') AS n2,
  count(*) FILTER (WHERE model_version = 'v1' AND ground_truth = result) AS s1,
  count(*) FILTER (WHERE model_version = 'v2' AND ground_truth = result) AS s2 FROM logs WHERE ground_truth IS NOT NULL GROUP BY model_id),
x AS (SELECT *, pow(s1 - n1 * (s1 + s2) / (n1 + n2), 2) / (n1 * (s1 + s2) / (n1 + n2))
  + pow(n1 - s1 - n1 * (n1 + n2 - s1 - s2) / (n1 + n2), 2) / (n1 * (n1 + n2 - s1 - s2) / (n1 + n2))
  + pow(s2 - n2 * (s1 + s2) / (n1 + n2), 2) / (n2 * (s1 + s2) / (n1 + n2))
  + pow(n2 - s2 - n2 * (n1 + n2 - s1 - s2) / (n1 + n2), 2) / (n2 * (n1 + n2 - s1 - s2) / (n1 + n2)) AS chi2,
  abs(2 * asin(sqrt(s1 / n1)) - 2 * asin(sqrt(s2 / n2))) AS h FROM p),
r AS (SELECT *, 1 - {erf_sql("sqrt(chi2 / 2)")} AS p FROM x)"""


@query("ab_proportions", f"""WITH {LOGS}, {PROPORTIONS} SELECT model_id, round(s1 / n1, 6) AS control_mean, round(s2 / n2, 6) AS variant_mean,
n1 AS control_count, n2 AS variant_count, round(chi2, 6) AS statistic, round(r.p, 6) AS p_value, r.p < 0.05 AS is_significant,
round(h, 6) AS effect_size, 0.95e0 AS confidence_level, {ab_advice_sql("r.p", "s2 / n2 > s1 / n1", "h")} AS recommendation,
'chi_squared' AS test_method FROM r""")
def ab_proportions(spark, d):
    labelled = views.prediction_logs(spark, d).filter("ground_truth IS NOT NULL")
    v1, right = F.col("model_version") == "v1", F.col("ground_truth") == F.col("result")
    counts = labelled.groupBy("model_id").agg(
        F.count_if(v1 & right).alias("control_successes"), F.count_if(v1).alias("control_total"),
        F.count_if(~v1 & right).alias("variant_successes"), F.count_if(~v1).alias("variant_total"),
    )
    return abtest.compare_proportions(counts, ["model_id"])


def _shifted(spark, d):
    extra = F.when(
        F.col("model_version") == "v2", 0.05 + 0.1 * F.substring("model_id", 2, 5).cast("int")
    ).otherwise(0.0)
    rows = views.prediction_logs(spark, d).withColumn("confidence", F.col("confidence") + extra)
    return abtest.compare_means(rows, ["model_id"], "confidence", F.col("model_version") == "v1")


@query("ab_recommend", f"""WITH {LOGS}, {SHIFTED} SELECT model_id, round(effect, 6) AS effect_size,
{ab_advice_sql("p", "m2 > m1", "effect")} AS recommendation FROM r""")
def ab_recommend(spark, d):
    return _shifted(spark, d).select("model_id", "effect_size", "recommendation")


@query("ab_report", f"""WITH {LOGS}, {SHIFTED} SELECT model_id, 'model_comparison' AS test_name, 'champion' AS control,
'challenger' AS variant, round(m1, 4) AS control_mean, round(m2, 4) AS variant_mean, CAST(n1 AS BIGINT) AS control_count,
CAST(n2 AS BIGINT) AS variant_count, round(p, 6) AS p_value, p < 0.05 AS is_significant, round(effect, 4) AS effect_size,
{ab_advice_sql("p", "m2 > m1", "effect")} AS recommendation FROM r""")
def ab_report(spark, d):
    return abtest.report(_shifted(spark, d), ["model_id"])


@query("norm_cdf", f"""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
z AS (SELECT event_id, (value - m) / s AS z FROM events, s)
SELECT event_id, round(0.5e0 * (1 + {erf_sql("(z / sqrt(2.0e0))")}), 6) AS cdf FROM z""")
def norm_cdf_query(spark, d):
    e = views.events(spark, d)
    moments = e.agg(F.struct(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))).scalar()
    z = (F.col("value") - F.col("_m")["m"]) / F.col("_m")["s"]
    return e.withColumn("_m", moments).select("event_id", norm_cdf(z).alias("cdf"))


@query("chi2_cdf1", f"""SELECT event_id, round(CASE WHEN value / 50 <= 0 THEN 0 ELSE {erf_sql("sqrt(value / 100)")} END, 6) AS cdf FROM events""")
def chi2_cdf1_query(spark, d):
    return views.events(spark, d).select("event_id", chi2_cdf1(F.col("value") / 50).alias("cdf"))


@query("model_health", f"""WITH {LOGS} SELECT model_id, model_version, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS errors,
round(avg(latency_ms), 6) AS avg_latency_ms FROM logs GROUP BY ALL""")
def model_health(spark, d):
    return health(views.prediction_logs(spark, d), ["model_id", "model_version"])
