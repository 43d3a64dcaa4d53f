"""Queries over the prediction log and validation of prediction requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.operators.ordered import running_sums, top_per_key


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def recent_logs(logs: DataFrame, limit: int = config.RECENT_LOGS, model_id: str | None = None) -> DataFrame:
    """Newest `limit` rows of one model, or of every model.

    One model is a top-k; all models are a top-k per key.
    """
    if model_id is not None:
        return logs.filter(F.col("model_id") == model_id).orderBy(*newest_first()).limit(limit)
    return top_per_key(logs, ["model_id"], newest_first(), limit, "id")


def labeled_logs(logs: DataFrame, limit: int | None = config.LABELED_LOGS, model_id: str | None = None) -> DataFrame:
    """Newest labelled rows (all without a limit): target, prediction, confidence and an ISO time."""
    rows = logs.filter(F.col("ground_truth").isNotNull())
    if limit is not None:
        rows = recent_logs(rows, limit, model_id)
    elif model_id is not None:
        rows = rows.filter(F.col("model_id") == model_id)
    return rows.select(
        "id", "model_id", "features",
        F.col("ground_truth").alias("target"),
        F.col("result").alias("prediction"),
        "confidence",
        iso_utc("created_at").alias("created_at"),
    )


def iso_utc(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def prediction_log_view(logs: DataFrame, limit: int = 100) -> DataFrame:
    """What a log listing shows: the newest rows of every model."""
    return recent_logs(logs, limit).select(
        "id", "model_id", F.col("model_version").alias("version"), "result", "confidence", "latency_ms"
    )


def attach_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set ground_truth from feedback rows (id, ground_truth, received_at); the latest per id wins."""
    latest = feedback.groupBy("id").agg(
        F.max_by("ground_truth", "received_at").alias("_given")
    )
    return (
        logs.join(latest, "id", "left")
        .withColumn("ground_truth", F.coalesce("_given", "ground_truth"))
        .drop("_given")
    )


def request_errors(features: str, model_id: str, expected_count: int | None = None,
                   feature_names: list[str] | None = None,
                   ranges: dict[str, tuple[float, float]] | None = None,
                   max_features: int = config.MAX_FEATURES) -> Column:
    """All problems of a feature vector as an array of messages; empty means valid.

    Ranges apply by position. An empty vector yields that single error.
    """
    vector = F.col(features)
    count = F.size(vector)
    checks: list[Column] = [
        F.when(
            count > max_features,
            F.format_string(f"Too many features: %d (max: {max_features})", count),
        )
    ]
    if expected_count:
        checks.append(
            F.when(
                count != expected_count,
                F.format_string(
                    f"Feature count mismatch: got %d, expected {expected_count} for model %s",
                    count, F.col(model_id),
                ),
            )
        )
    if feature_names:
        checks.append(
            F.when(
                count != len(feature_names),
                F.format_string(
                    "Feature count doesn't match model schema: "
                    f"got %d, schema has {len(feature_names)} features",
                    count,
                ),
            )
        )
    for i, (name, (lo, hi)) in enumerate((ranges or {}).items()):
        value = F.get(vector, F.lit(i))
        # Spark orders NaN above every number; a NaN is reported below, not as out of range.
        outside = ((value < lo) | (value > hi)) & ~F.isnan(value)
        checks.append(
            F.when(
                outside,
                F.concat(
                    F.lit(f"Feature '{name}' value "), value.cast("string"),
                    F.lit(f" out of range [{lo}, {hi}]"),
                ),
            )
        )
    infinite = float("inf")
    bad_numbers = F.transform(
        vector,
        lambda v, i: F.when(F.isnan(v), F.concat(F.lit("Feature at index "), i, F.lit(" is NaN"))).when(
            F.abs(v) == infinite, F.concat(F.lit("Feature at index "), i, F.lit(" is infinite"))
        ),
    )
    found = F.filter(F.concat(F.array(*checks), bad_numbers), lambda e: e.isNotNull())
    empty = vector.isNull() | (count == 0)
    return F.when(empty, F.array(F.lit("Features list cannot be empty"))).otherwise(found)


def missing_inputs(model_id: str = "model_id", features: str = "features", entity_id: str = "entity_id") -> Column:
    """First problem of a prediction request, or null."""
    has_features = F.col(features).isNotNull() & (F.size(features) > 0)
    return F.when(
        F.col(model_id).isNull() | (F.col(model_id) == ""), F.lit("model_id is required")
    ).when(
        ~has_features & F.col(entity_id).isNull(),
        F.lit("Either features or entity_id must be provided"),
    )


def confident(logs: DataFrame, threshold: float) -> DataFrame:
    return logs.filter(F.col("confidence") >= threshold)


def budget_violations(logs: DataFrame, budget_ms: float, keys: list[str]) -> DataFrame:
    """Requests over the latency budget and their share, per key."""
    over = F.col("latency_ms") > budget_ms
    return logs.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(over).alias("violations"),
        F.avg(over.cast("double")).alias("violation_rate"),
    )


_VERSION = r"^(\d+)\.(\d+)\.(\d+)$"


def version_parts(version: Column) -> Column:
    """MAJOR.MINOR.PATCH as a comparable struct; null when the text is not a version."""
    numbers = [F.regexp_extract(version, _VERSION, i).try_cast("bigint") for i in (1, 2, 3)]
    return F.when(
        version.rlike(_VERSION),
        F.struct(numbers[0].alias("major"), numbers[1].alias("minor"), numbers[2].alias("patch")),
    )


def latest_version(versions: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Highest version per key."""
    parsed = versions.withColumn("_v", version_parts(F.col(version))).filter("_v IS NOT NULL")
    return parsed.groupBy(*keys).agg(F.max_by(version, "_v").alias("latest_version"))


def rejected_versions(versions: DataFrame, version: str = "version") -> DataFrame:
    return versions.filter(~F.coalesce(F.col(version).rlike(_VERSION), F.lit(False)))


def cast_features(df: DataFrame, columns: list[str], reject: bool = False) -> DataFrame:
    """Cast every feature to double; rows with any uncastable value go to the reject set."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    if reject:
        return df.filter(bad)
    return df.filter(~bad).withColumns({c: F.col(c).try_cast("double") for c in columns})


def rolling_request_flags(logs: DataFrame, key: str, limit: int = config.REQUESTS_PER_MINUTE,
                          window_seconds: int = 60, chunks: int | None = None) -> DataFrame:
    """Flag requests with more than `limit` requests of the key in the window ending at them.

    Audits a log after the fact, so rejected requests count too. A request arrives at
    its time and leaves one window later; the running sum of arrivals minus departures
    is the count, so the cost does not depend on how many requests a window holds and
    a hot key is cut into chunks.
    """
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    span = window_seconds * 1_000_000
    base = logs.select(key, "id", at.alias("_at"))
    moves = base.select(
        key,
        F.inline(
            F.array(
                F.struct(F.col("_at"), F.lit(1).cast("bigint").alias("_move"), F.lit(1).alias("_arrived")),
                F.struct((F.col("_at") + span).alias("_at"), F.lit(-1).cast("bigint").alias("_move"), F.lit(0).alias("_arrived")),
            )
        ),
    )
    instants = moves.groupBy(key, "_at").agg(F.sum("_move").alias("_move"), F.max("_arrived").alias("_arrived"))
    counted = running_sums(instants, [key], ["_at"], {"requests_in_window": "_move"}, chunks).filter("_arrived = 1")
    return base.join(counted.select(key, "_at", "requests_in_window"), [key, "_at"]).select(
        "id", key, "requests_in_window", (F.col("requests_in_window") > limit).alias("limited")
    )
