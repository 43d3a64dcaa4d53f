"""Schemas of the system tables."""

from __future__ import annotations

PREDICTION_LOGS = (
    "id bigint, model_id string, model_version string, features array<double>, "
    "result double, confidence double, latency_ms double, ground_truth double, created_at timestamp"
)
MODELS = (
    "id string, version string, uri string, framework string, stage string, metadata string, "
    "metrics map<string,double>, created_at timestamp, is_active boolean"
)
DRIFT_REPORTS = (
    "model_id string, feature_name string, drift_detected boolean, p_value double, statistic double, "
    "threshold double, method string, recommendation string, sample_size bigint, analyzed_at timestamp"
)
FEATURE_VALUES = (
    "entity_id bigint, feature string, value double, event_ts timestamp, expires_at timestamp"
)
REFERENCE_FEATURES = "model_id string, version string, feature_name string, value double"
ALERT_RULES = (
    "rule_name string, metric string, threshold double, severity string, comparison string, "
    "cooldown_seconds double, description string"
)
INFERENCE_EVENT = (
    "event_id bigint, event_type string, model_id string, version string, features array<double>, "
    "result double, confidence double, timestamp timestamp"
)
AUDIT_ENTRY = (
    "action string, user string, ip_address string, resource string, timestamp string, "
    "success boolean, details string, correlation_id string"
)
RUNS = (
    "run_id string, experiment_name string, model_type string, params map<string,string>, "
    "metrics map<string,double>, tags map<string,string>, start_time timestamp, end_time timestamp, "
    "duration_seconds double"
)
JOB_EVENTS = "job_id string, model_id string, status string, at timestamp"
REGISTRY_EVENTS = (
    "seq bigint, at timestamp, model_id string, version string, action string, stage string, uri string, "
    "framework string, metrics map<string,double>"
)
