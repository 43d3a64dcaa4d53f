"""Fixed thresholds, default rules and task defaults.

All values here are fixed values that results depend on.
"""

from __future__ import annotations

# Drift
PSI_STABLE = 0.1
PSI_DRIFT = 0.25
PSI_EPSILON = 1e-10
WASSERSTEIN_FACTOR = 0.5
CRITICAL_STATISTIC = 0.5
HISTOGRAM_BINS = 10
MIN_POINTS = 5
RECENT_LOGS = 1000
LABELED_LOGS = 10_000

# Anomalies
Z_THRESHOLD = 3.0
ANOMALOUS_SHARE = 0.1
MIN_STD = 1e-10
LATENCY_MULTIPLIER = 2.0
ERROR_RATE_LIMIT = 0.05

# Rollback
ROLLBACK_ERROR_RATE = 0.10
ROLLBACK_LATENCY_MS = 500.0
ROLLBACK_MIN_REQUESTS = 50

# A/B
AB_CONFIDENCE = 0.95
AB_NEGLIGIBLE = 0.2
AB_LARGE = 0.8

# Data quality
MAX_NULL_PERCENT = 30.0
OUTLIER_IQR = 3.0
MAX_DUPLICATE_PERCENT = 10.0
GATE_MIN_ROWS = 10
GATE_MAX_NULL_PERCENT = 50.0
MAX_CLASSES = 20

# Requests
MAX_FEATURES = 10_000
CACHE_TTL_SECONDS = 300
REQUESTS_PER_MINUTE = 60

# Histogram buckets of the dashboard metrics (upper bounds; +Inf is implied)
LATENCY_BUCKETS_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0]
CONFIDENCE_BUCKETS = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99, 1.0]

# name, metric, threshold, severity, comparison, cooldown seconds, description
DEFAULT_ALERT_RULES = [
    ("high_drift_score", "drift_score", 0.3, "critical", "gt", 300.0,
     "Data drift score exceeds critical threshold"),
    ("moderate_drift_score", "drift_score", 0.1, "warning", "gt", 120.0,
     "Data drift score exceeds warning threshold"),
]

# task type -> drift test, primary metric, data source, retrain trigger, drift monitored
TASK_DEFAULTS = {
    "classification": ("ks", "accuracy", "file", "drift", True),
    "regression": ("wasserstein", "rmse", "file", "drift", True),
    "image": ("chi2", "accuracy", "file", "drift", True),
    "image_classification": ("chi2", "accuracy", "file", "drift", True),
    "object_detection": ("ks", "map", "dvc", "data_change", False),
    "nlp": ("ks", "accuracy", "file", "manual", False),
    "custom": ("ks", "accuracy", "file", "manual", True),
}
FALLBACK_TASK = ("ks", "accuracy", "file", "drift", True)
LOWER_IS_BETTER = ["rmse", "mae", "mape"]
REGRESSION_TASKS = ["regression", "timeseries"]
