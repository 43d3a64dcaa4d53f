"""Time-windowed dashboard metrics, for tables and for streams.

Every metric is a table of counts per window that can be added up, and a column expression over the sums. A stream
counts each micro-batch on its own and stores the counts under the batch's id (`events.stored_counts`); adding up
what is stored gives the metric. So rows count whenever they arrive, in whatever order files are read, the last
window is there, and a batch that runs again replaces its own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import config


def with_lateness(stream: DataFrame, at: str = "created_at", lateness: str = "10 minutes") -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)


def _starts(column: str = "w") -> Column:
    return F.unix_timestamp(F.col(f"{column}.start").cast("timestamp")).alias("window_start")


def added(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of several batches as one row per window and key."""
    numbers = [c for c in counts.columns if c not in ("window_start", "batch_id", *keys)]
    return counts.groupBy("window_start", *keys).agg(*[F.sum(c).alias(c) for c in numbers])


def rate_counts(logs: DataFrame, keys: list[str], window: str = "1 minute", at: str = "created_at") -> DataFrame:
    counts = logs.groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("requests"))
    return counts.select(_starts(), *keys, "requests")


def rates(counts: DataFrame, seconds: int = 60) -> DataFrame:
    return counts.withColumn("rate", F.col("requests") / float(seconds))


def request_rate(logs: DataFrame, keys: list[str], window: str = "1 minute", seconds: int = 60,
                 at: str = "created_at") -> DataFrame:
    """Requests per second in each tumbling window."""
    return rates(rate_counts(logs, keys, window, at), seconds)


def error_counts(logs: DataFrame, keys: list[str], window: str = "1 hour", at: str = "created_at") -> DataFrame:
    failed = F.col("status") == "error"
    stats = logs.groupBy(F.window(at, window).alias("w"), *keys).agg(
        F.count("*").alias("total"), F.count_if(failed).alias("failed")
    )
    return stats.select(_starts(), *keys, "total", "failed")


def error_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("error_rate", F.col("failed") / F.col("total"))


def error_rate(logs: DataFrame, keys: list[str], window: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Failed / total in each window."""
    return error_rates(error_counts(logs, keys, window, at))


def bucket_quantile(counts: list[str], bounds: list[float], q: float) -> str:
    """SQL of a quantile from cumulative bucket counts (the last entry is the total).

    Linear inside the first bucket that reaches the rank; the lowest bucket starts at
    0, and a rank beyond the last bound gives that bound.
    """
    total = counts[-1]
    rank = f"({q!r}D * {total})"
    arms = [f"WHEN {total} = 0 THEN NULL"]
    low, before = 0.0, "0"
    for high, upto in zip(bounds, counts):
        inside = f"{low!r}D + {high - low!r}D * ({rank} - {before}) / ({upto} - {before})"
        arms.append(f"WHEN {upto} >= {rank} THEN CASE WHEN {upto} = {before} THEN {high!r}D ELSE {inside} END")
        low, before = high, upto
    return f"CASE {' '.join(arms)} ELSE {bounds[-1]!r}D END"


def bucket_counts(logs: DataFrame, value: Column, bounds: list[float], keys: list[str], slide: str = "1 minute",
                  at: str = "created_at") -> DataFrame:
    """Rows and rows up to each bound, per slide: every row is counted once, not once per window it lies in."""
    counters = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    grouped = logs.groupBy(F.window(at, slide).alias("w"), *keys).agg(
        *counters, F.count(value).alias(f"b{len(bounds)}")
    )
    return grouped.select(_starts(), *keys, *[f"b{i}" for i in range(len(bounds) + 1)])


def quantiles_of(counts: DataFrame, bounds: list[float], quantiles: dict[str, float], keys: list[str],
                 slides: int = 5, seconds: int = 60) -> DataFrame:
    """Quantiles per sliding window of `slides` slides of `seconds` each, from the counts per slide."""
    begins = F.transform(F.sequence(F.lit(0), F.lit(slides - 1)), lambda i: F.col("window_start") - i * seconds)
    spread = counts.withColumn("window_start", F.explode(begins))
    names = [f"b{i}" for i in range(len(bounds) + 1)]
    return added(spread.select("window_start", *keys, *names), keys).select(
        "window_start", *keys, F.col(names[-1]).alias("requests"),
        *[F.expr(bucket_quantile(names, bounds, q)).alias(name) for name, q in quantiles.items()],
    )


LATENCY_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_counts(logs: DataFrame, keys: list[str] = ["model_id"]) -> DataFrame:
    return bucket_counts(logs, F.col("latency_ms") / 1000.0, config.LATENCY_BUCKETS_SECONDS, keys)


def latency_quantiles_of(counts: DataFrame, keys: list[str] = ["model_id"]) -> DataFrame:
    return quantiles_of(counts, config.LATENCY_BUCKETS_SECONDS, LATENCY_QUANTILES, keys)


def latency_quantiles(logs: DataFrame, keys: list[str] = ["model_id"]) -> DataFrame:
    return latency_quantiles_of(latency_counts(logs, keys), keys)


def confidence_quantile(logs: DataFrame, keys: list[str] = ["model_id"]) -> DataFrame:
    counts = bucket_counts(logs, F.col("confidence"), config.CONFIDENCE_BUCKETS, keys)
    return quantiles_of(counts, config.CONFIDENCE_BUCKETS, {"median": 0.5}, keys)


def latest_metric(values: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Gauge: the newest value per key."""
    return values.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def drop_repeats(stream: DataFrame, keys: list[str], at: str = "created_at", within: str = "5 minutes") -> DataFrame:
    """Streaming twin of the request cache: repeats of a key inside the watermark are dropped."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def join_feedback(logs: DataFrame, feedback: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of predictions with feedback (id, ground_truth, received_at) that
    arrives within a bounded time; both sides need a watermark so that state is dropped."""
    f = feedback.select(
        F.col("id").alias("_id"), F.col("ground_truth").alias("_given"), "received_at"
    )
    condition = (
        (F.col("id") == F.col("_id")) & (F.col("received_at") >= F.col("created_at"))
        & (F.col("received_at") <= F.col("created_at") + F.expr(f"INTERVAL {within}"))
    )
    return logs.join(f, condition, "left").withColumn(
        "ground_truth", F.coalesce("_given", "ground_truth")
    ).drop("_id", "_given", "received_at")
