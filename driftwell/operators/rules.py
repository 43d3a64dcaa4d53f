"""Anomaly, alert, rollback, promotion and gate rules as columns over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.functions.text import fixed
from driftwell.operators.smallside import join_small
from driftwell.operators.ordered import percentiles, planned_chunks
from driftwell.operators.spacing import spaced
from driftwell.schemas import ALERT_RULES


def _anomaly(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return df.select(
        *keys, F.lit(kind).alias("anomaly_type"), "is_anomalous", "score", "threshold", "detail", "sample_size"
    )


def percent_text(value: Column, digits: int) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def confidence_anomaly(logs: DataFrame, keys: list[str], baseline: DataFrame | None = None,
                       value: str = "confidence", z_threshold: float = config.Z_THRESHOLD) -> DataFrame:
    """Share of z-scores over the threshold against a baseline (keys, mean, std) or the own moments.

    The moments are one row per key, so the second pass meets a measured, broadcast table.
    """
    moments = baseline if baseline is not None else logs.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    joined = join_small(logs.select(*keys, value), moments, keys, "inner")
    z = F.abs(F.col(value) - F.col("mean")) / F.col("std")
    usable = F.col("std") >= config.MIN_STD
    stats = joined.withColumn("z", F.when(usable, z)).groupBy(*keys).agg(
        F.max("z").alias("max_z"),
        F.avg((F.col("z") > z_threshold).cast("double")).alias("ratio"),
        F.count("*").alias("sample_size"),
    )
    flat = F.col("max_z").isNull()
    return _anomaly(
        stats.withColumns(
            {
                "is_anomalous": F.coalesce(F.col("ratio") > config.ANOMALOUS_SHARE, F.lit(False)),
                "score": F.coalesce("max_z", F.lit(0.0)),
                "threshold": F.lit(z_threshold),
                "detail": F.when(flat, F.lit("Zero variance in confidence scores")).otherwise(
                    F.concat(
                        percent_text(F.col("ratio"), 1),
                        F.lit(" of predictions exceed z-score threshold ("),
                        fixed(F.col("max_z"), 2), F.lit(" max)"),
                    )
                ),
            }
        ),
        keys, "prediction_anomaly",
    )


def latency_anomaly(logs: DataFrame, keys: list[str], baseline: DataFrame,
                    multiplier: float = config.LATENCY_MULTIPLIER, chunks: int | None = None) -> DataFrame:
    """99th percentile against a multiple of the baseline's (keys, baseline_p99)."""
    current = percentiles(logs, keys, "latency_ms", {"p99": 0.99}, chunks)
    sizes = logs.groupBy(*keys).agg(F.count("*").alias("sample_size"))
    joined = current.join(sizes, keys).join(baseline, keys)
    limit = F.col("baseline_p99") * multiplier
    ratio = F.when(F.col("baseline_p99") > 0, F.col("p99") / F.col("baseline_p99")).otherwise(F.lit(0.0))
    return _anomaly(
        joined.withColumns(
            {
                "is_anomalous": F.col("p99") > limit,
                "score": F.col("p99"),
                "threshold": limit,
                "detail": F.concat(
                    F.lit("p99="), fixed(F.col("p99"), 1), F.lit("ms ("), fixed(ratio, 1), F.lit("x baseline "),
                    fixed(F.col("baseline_p99"), 1), F.lit("ms)"),
                ),
            }
        ),
        keys, "latency_spike",
    )


def error_rate_anomaly(counts: DataFrame, keys: list[str], limit: float = config.ERROR_RATE_LIMIT) -> DataFrame:
    """Input columns: total, errors."""
    rate = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    empty = F.col("total") == 0
    return _anomaly(
        counts.withColumns(
            {
                "is_anomalous": rate > limit,
                "score": rate,
                "threshold": F.lit(limit),
                "detail": F.when(empty, F.lit("No requests recorded")).otherwise(
                    F.concat(
                        F.format_string("%d/%d errors (", F.col("errors"), F.col("total")),
                        percent_text(rate, 2), F.lit(")"),
                    )
                ),
                "sample_size": F.col("total"),
            }
        ),
        keys, "error_rate",
    )


def breaches(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric points (metric, model_id, value, at, id) that break a rule; unknown comparisons mean gt.

    The rule table is a handful of rows without a size the planner knows: broadcast, or all points of a metric would
    meet in one task.
    """
    value, threshold, how = F.col("value"), F.col("threshold"), F.col("comparison")
    broken = (
        F.when(how == "lt", value < threshold)
        .when(how == "gte", value >= threshold)
        .when(how == "lte", value <= threshold)
        .otherwise(value > threshold)
    )
    return metrics.join(F.broadcast(rules), "metric").filter(broken)


def alert_message() -> Column:
    return F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule_name"), F.lit(": "), F.col("metric"),
        F.lit("="), fixed(F.col("value"), 4), F.lit(" breached threshold "), F.col("threshold").cast("string"),
        F.lit(" ("), F.col("comparison"), F.lit("). "), F.col("description"),
    )


def alert_columns() -> list[Column | str]:
    """An alert row, of a breach and its rule."""
    return [
        "rule_name", "severity", F.lit("firing").alias("status"), F.col("value").alias("metric_value"),
        "threshold", alert_message().alias("message"), "model_id", "at", "id",
    ]


def evaluate_alerts(metrics: DataFrame, rules: list[tuple], per_model: bool = False,
                    chunks: int | None = None, last_fired: DataFrame | None = None) -> DataFrame:
    """Alerts that fire. A rule stays silent for its cooldown, counted over all models
    (or per model when `per_model`). `last_fired` (keys, last_kept) continues earlier runs."""
    spark = metrics.sparkSession
    numbered = [(*r, i) for i, r in enumerate(rules)]
    table = spark.createDataFrame(numbered, f"{ALERT_RULES}, _rule int")
    keys = ["rule_name", "model_id"] if per_model else ["rule_name"]
    # Breaches are sorted and replayed without the texts of their rule, which only those that fire get back.
    hits = breaches(metrics, table).select("rule_name", "_rule", "cooldown_seconds", "model_id", "at", "id", "value")
    # The rule table has no known size, so the number of chunks follows the metrics alone.
    fired = spaced(
        hits, keys, "at", ["model_id", "id"], F.col("cooldown_seconds"), "fires", chunks=chunks or planned_chunks(metrics), entries=last_fired
    ).filter("fires").drop("rule_name", "cooldown_seconds", "fires")
    return fired.join(F.broadcast(table), "_rule").select(*alert_columns())


def rollback_decision(health: DataFrame, keys: list[str], max_error_rate: float = config.ROLLBACK_ERROR_RATE,
                      max_latency_ms: float = config.ROLLBACK_LATENCY_MS,
                      min_requests: int = config.ROLLBACK_MIN_REQUESTS) -> DataFrame:
    """Input columns: total, errors, avg_latency_ms. Checks run in order; the first that holds decides."""
    few = F.col("total") < min_requests
    rate = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    failing = rate > max_error_rate
    slow = F.col("avg_latency_ms") > max_latency_ms
    reason = (
        F.when(few, F.format_string(f"Insufficient data: %d/{min_requests} requests", F.col("total")))
        .when(
            failing,
            F.concat(
                F.lit("Error rate "), percent_text(rate, 2),
                F.lit(f" exceeds threshold {max_error_rate:.2%}"),
            ),
        )
        .when(
            slow,
            F.concat(
                F.lit("Avg latency "), fixed(F.col("avg_latency_ms"), 1),
                F.lit(f"ms exceeds threshold {max_latency_ms:.1f}ms"),
            ),
        )
        .otherwise(F.lit("Challenger is healthy"))
    )
    return health.select(
        *keys,
        (~few & (failing | slow)).alias("should_rollback"),
        reason.alias("reason"),
        F.when(few, F.lit(0.0)).otherwise(rate).alias("error_rate"),
        F.when(few, F.lit(0.0)).otherwise(F.col("avg_latency_ms")).alias("avg_latency_ms"),
    )


def is_better(task_type: Column, metric: Column, challenger: Column, champion: Column) -> Column:
    """Challenger beats champion. A missing challenger metric is never better for regression."""
    regression = task_type.isin(config.REGRESSION_TASKS)
    lower = metric.isin(config.LOWER_IS_BETTER)
    zero = F.lit(0.0)
    return (
        F.when(
            regression & lower,
            F.coalesce(challenger < F.coalesce(champion, F.lit(float("inf"))), F.lit(False)),
        )
        .when(regression, F.coalesce(challenger > F.coalesce(champion, F.lit(float("-inf"))), F.lit(False)))
        .otherwise(F.coalesce(challenger, zero) > F.coalesce(champion, zero))
    )


def promote_decision(champions: DataFrame, challengers: DataFrame, task_type: str = "classification",
                     metric: str | None = None) -> DataFrame:
    """Join (model_id, metrics map) of both roles and decide by the primary metric."""
    primary = metric or ("rmse" if task_type in config.REGRESSION_TASKS else "f1_score")
    pairs = champions.select("model_id", F.col("metrics").alias("champion")).join(
        challengers.select("model_id", F.col("metrics").alias("challenger")), "model_id"
    )
    ours, theirs = F.try_element_at("challenger", F.lit(primary)), F.try_element_at("champion", F.lit(primary))
    better = is_better(F.lit(task_type), F.lit(primary), ours, theirs)
    return pairs.select(
        "model_id", F.lit(primary).alias("metric"), theirs.alias("champion_value"),
        ours.alias("challenger_value"), better.alias("promote"),
        F.when(better, F.lit("champion")).otherwise(F.lit("challenger")).alias("role"),
    )


def model_comparison(champions: DataFrame, challengers: DataFrame) -> DataFrame:
    """Every metric of both roles side by side with its difference."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("model_id", F.explode("metrics").alias("metric", name))

    return long(champions, "champion").join(
        long(challengers, "challenger"), ["model_id", "metric"], "full_outer"
    ).withColumn("delta", F.col("challenger") - F.col("champion"))


def metric_gate(runs: DataFrame, minimums: dict[str, float], keys: list[str]) -> DataFrame:
    """Every required metric must reach its minimum; a missing one counts as 0.

    The error names the first one that fails, in the order given.
    """
    fails = []
    for name, least in minimums.items():
        value = F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0))
        fails.append(
            F.when(
                value < least,
                F.concat(F.lit(f"Validation failed: {name}="), fixed(value, 4), F.lit(f" < threshold={least}")),
            )
        )
    message = F.coalesce(*fails)
    return runs.select(*keys, message.isNull().alias("passed"), message.alias("error"))
