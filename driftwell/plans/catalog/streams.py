"""Windowed metrics over tables, and the same jobs as streams drained to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell import config
from driftwell.plans import views
from driftwell.plans.catalog.base import LOGS, ORACLES, query
from driftwell.plans.catalog.rules import METRICS, RULES
from driftwell.plans.checks import ModelConfig
from driftwell.schemas import INFERENCE_EVENT
from driftwell.session import ensure_checkpoints, scratch_path
from driftwell.streaming import events as E
from driftwell.streaming import monitor
from driftwell.streaming import windows as W


def event_stream(spark, d, max_files=None):
    return E.file_stream(spark, f"{d}/events.parquet", views.events(spark, d).schema, max_files)


def log_stream(spark, d, max_files=None):
    return views.from_events(event_stream(spark, d, max_files))


RATE = """SELECT CAST(floor(epoch(created_at) / 60) * 60 AS BIGINT) AS window_start, model_id, model_version, count(*) AS requests, round(count(*) / 60.0e0, 6) AS rate FROM logs GROUP BY ALL"""


@query("request_rate", f"WITH {LOGS} {RATE}")
def request_rate(spark, d):
    return W.request_rate(views.prediction_logs(spark, d), ["model_id", "model_version"])


@query("stream_request_rate", f"WITH {LOGS} {RATE}")
def stream_request_rate(spark, d, max_files=None):
    keys = ["model_id", "model_version"]
    counts = E.stored_counts(log_stream(spark, d, max_files), lambda logs: W.rate_counts(logs, keys), "request_rate")
    return W.rates(W.added(counts, keys))


ERRORS = """SELECT CAST(floor(epoch(created_at) / 3600) * 3600 AS BIGINT) AS window_start, model_id, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS failed,
round(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_rate FROM logs GROUP BY ALL"""


@query("error_rate_gauge", f"WITH {LOGS} {ERRORS}")
def error_rate_gauge(spark, d):
    return W.error_rate(views.prediction_logs(spark, d), ["model_id"])


@query("stream_error_rate", f"WITH {LOGS} {ERRORS}")
def stream_error_rate(spark, d, max_files=None):
    counts = E.stored_counts(log_stream(spark, d, max_files), lambda logs: W.error_counts(logs, ["model_id"]), "error_rate")
    return W.error_rates(W.added(counts, ["model_id"]))


def buckets_sql(value: str, bounds: list[float], quantiles: dict[str, float], window: int = 300, slide: int = 60) -> str:
    counters = ", ".join(f"count(*) FILTER (WHERE {value} <= {b}e0) AS b{i}" for i, b in enumerate(bounds))
    last = len(bounds)
    pick = []
    for name, q in quantiles.items():
        arms = []
        for i in range(last):
            lo = 0.0 if i == 0 else bounds[i - 1]
            prev = "0" if i == 0 else f"b{i - 1}"
            arms.append(
                f"WHEN b{i} >= {q}e0 * n THEN coalesce({lo}e0 + ({bounds[i]}e0 - {lo}e0) * ({q}e0 * n - {prev}) / nullif(b{i} - {prev}, 0), {bounds[i]}e0)"
            )
        pick.append(f"round(CASE {' '.join(arms)} ELSE {bounds[-1]}e0 END, 6) AS {name}")
    return f"""spread AS (SELECT *, unnest(list_transform(range(0, {window // slide}), lambda i: CAST(floor(epoch(created_at) / {slide}) * {slide} AS BIGINT) - i * {slide})) AS window_start FROM logs),
counted AS (SELECT window_start, model_id, count(*) AS n, {counters} FROM spread GROUP BY ALL),
quant AS (SELECT window_start, model_id, n AS requests, {', '.join(pick)} FROM counted)"""


LATENCY = buckets_sql("latency_ms / 1000", config.LATENCY_BUCKETS_SECONDS, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
CONFIDENCE = buckets_sql("confidence", config.CONFIDENCE_BUCKETS, {"median": 0.5})


@query("latency_quantiles", f"WITH {LOGS}, {LATENCY} SELECT * FROM quant")
def latency_quantiles(spark, d):
    return W.latency_quantiles(views.prediction_logs(spark, d))


@query("stream_latency_quantiles", f"WITH {LOGS}, {LATENCY} SELECT * FROM quant")
def stream_latency_quantiles(spark, d, max_files=None):
    counts = E.stored_counts(log_stream(spark, d, max_files), W.latency_counts, "latency_quantiles")
    return W.latency_quantiles_of(W.added(counts, ["model_id"]))


@query("confidence_quantile", f"WITH {LOGS}, {CONFIDENCE} SELECT * FROM quant")
def confidence_quantile(spark, d):
    return W.confidence_quantile(views.prediction_logs(spark, d))


@query("primary_metric_gauge", f"""WITH {LOGS}, c AS (SELECT model_id, model_version, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, avg(CASE WHEN ground_truth = result THEN 1.0e0 ELSE 0 END) AS value
 FROM logs WHERE ground_truth IS NOT NULL GROUP BY ALL) SELECT model_id, model_version, 'accuracy' AS metric_name, round(arg_max(value, day), 6) AS value, max(day) AS day FROM c GROUP BY ALL""")
def primary_metric_gauge(spark, d):
    from driftwell.operators.metrics import classification_metrics

    rows = views.prediction_logs(spark, d).withColumn("day", F.to_date("created_at").cast("string"))
    daily = classification_metrics(rows, ["model_id", "model_version", "day"])
    named = daily.select("model_id", "model_version", F.lit("accuracy").alias("metric_name"), F.col("accuracy").alias("value"), "day")
    return W.latest_metric(named, ["model_id", "model_version", "metric_name"], "value", "day")


# Events as JSON messages: every 50th is cut off and every 41st lacks its model. ---

def _messages(e):
    log = views.from_events(e).withColumn("event_type", F.when(F.col("status") == "error", F.lit("prediction_failed")).otherwise(F.lit("prediction_completed")))
    body = F.to_json(
        F.struct(
            F.col("id").alias("event_id"), "event_type",
            F.when(F.col("id") % 41 != 0, F.col("model_id")).alias("model_id"),
            F.col("model_version").alias("version"), "features", "result", "confidence",
            F.col("created_at").cast("timestamp").alias("timestamp"),
        )
    )
    broken = F.substring(body, F.lit(1), F.length(body) - 20)
    return log.select(
        F.when(F.col("id") % 50 == 0, broken).otherwise(body).alias("json"), F.col("id").alias("offset")
    )


def _parsed_stream(spark, d):
    return E.parse(_messages(event_stream(spark, d)), INFERENCE_EVENT)


OK = "id % 50 <> 0 AND id % 41 <> 0"


@query("source_stream_events", f"""WITH {LOGS} SELECT id AS event_id, model_id, model_version AS version, f0, result, round(confidence, 6) AS confidence FROM logs WHERE {OK}""")
def source_stream_events(spark, d):
    rows = E.run_to_table(E.accepted(_parsed_stream(spark, d)), "events")
    return rows.select("event_id", "model_id", "version", F.col("features")[0].alias("f0"), "result", "confidence")


@query("stream_dead_letter", f"""WITH {LOGS} SELECT id AS "offset", 'inference-events' AS source_topic, CASE WHEN id % 50 = 0 THEN 'malformed event' ELSE 'model_id is required' END AS error,
CAST(3 AS INTEGER) AS max_retries FROM logs WHERE NOT ({OK})""")
def stream_dead_letter(spark, d):
    return E.run_to_table(E.dead_letters(_parsed_stream(spark, d)), "dead_letters").drop("original_event")


@query("stream_stats", f"""WITH {LOGS} SELECT count(*) FILTER (WHERE {OK}) AS processed, count(*) FILTER (WHERE NOT ({OK})) AS errors, count(*) FILTER (WHERE NOT ({OK})) AS dlq FROM logs""")
def stream_stats(spark, d):
    return E.stream_stats(E.run_to_table(E.observed(_parsed_stream(spark, d)), "stats"))


@query("stream_route_events", f"""WITH {LOGS} SELECT CASE WHEN status = 'error' THEN 'failed' ELSE 'default' END AS handler, id AS event_id, model_id FROM logs WHERE {OK}""")
def stream_route_events(spark, d):
    path = scratch_path(spark, "routed")
    query_ = E.routed_stream(
        E.accepted(_parsed_stream(spark, d)), {"prediction_failed": E.table_handler(f"{path}/failed")},
        f"{path}/state", E.table_handler(f"{path}/default"), available_now=True,
    )
    query_.awaitTermination()
    sides = [
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("handler"), "event_id", "model_id")
        for name in ("failed", "default")
    ]
    return sides[0].unionByName(sides[1])


@query("sink_stream_events", f"""WITH {LOGS} SELECT id AS event_id, model_id FROM logs WHERE {OK}""")
def sink_stream_events(spark, d):
    out = E.run_to_table(E.publish(E.accepted(_parsed_stream(spark, d))), "published")
    back = F.from_json("value", INFERENCE_EVENT)
    return out.select(back.alias("e")).select("e.event_id", "e.model_id")


@query("stream_drift", f"SELECT model_id, feature_name, statistic, method, drift_detected, sample_size FROM ({ORACLES['drift_check']}) c")
def stream_drift(spark, d):
    from driftwell.plans.catalog.drifts import stored_reference

    path = scratch_path(spark, "stream_drift")
    configs = [ModelConfig("m0", "classification"), ModelConfig("m1", "regression"), ModelConfig("m2", "image")]
    ensure_checkpoints(spark)
    monitor.stream_drift(
        views.from_events(event_stream(spark, d)), stored_reference(spark, d), configs, f"{path}/reports",
        f"{path}/state", available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{path}/reports").select(
        "model_id", "feature_name", "statistic", "method", "drift_detected", "sample_size"
    )


@query("stream_alerts", f"""{METRICS} SELECT h.rule_name, model_id, id, us AS at_us, round(value, 6) AS metric_value FROM fired f JOIN hits h ON f.rule_name = h.rule_name AND f.n = h.n
WHERE h.metric = 'latency_ms'""")
def stream_alerts(spark, d):
    path = scratch_path(spark, "stream_alerts")
    log = views.from_events(event_stream(spark, d))
    points = log.select(
        F.lit("latency_ms").alias("metric"), "model_id", F.col("created_at").cast("timestamp").alias("at"),
        F.col("latency_ms").alias("value"), "id",
    )
    ensure_checkpoints(spark)
    rules = [r for r in RULES if r[1] == "latency_ms"]
    monitor.stream_alerts(points, rules, f"{path}/alerts", f"{path}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/alerts").select(
        "rule_name", "model_id", "id", F.unix_micros("at").alias("at_us"), "metric_value"
    )
