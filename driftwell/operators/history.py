"""Registry, job and experiment history folded from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.ordered import top_per_key

INACTIVE_STAGES = ["archived", "retired"]

# Job status -> statuses it may follow (None is the start of a job).
ALLOWED_BEFORE = {
    "pending": [None],
    "running": ["pending"],
    "completed": ["running"],
    "failed": ["pending", "running"],
    "cancelled": ["pending", "running"],
}


def registry_state(events: DataFrame) -> DataFrame:
    """Current row per (model, version) from a registry event log.

    Events: save (stage = role, default challenger), stage (new stage), rollback
    (archives that version). A promotion to champion retires whichever version was
    champion before. So a version's own latest event gives its stage, unless that
    event made it champion and a later promotion of another version took over: only
    each model's last promotion is needed, which is one small row per model.
    """
    order = F.struct("at", "seq")
    stage = (
        F.when(F.col("action") == "save", F.coalesce("stage", F.lit("challenger")))
        .when(F.col("action") == "rollback", F.lit("archived"))
        .otherwise(F.col("stage"))
    )
    staged = events.withColumn("_stage", stage)
    is_save = F.col("action") == "save"
    per_version = staged.groupBy("model_id", "version").agg(
        F.max_by("_stage", order).alias("stage"),
        F.max(order).alias("_latest"),
        F.max_by("uri", F.when(is_save, order)).alias("uri"),
        F.max_by("framework", F.when(is_save, order)).alias("framework"),
        F.max_by("metrics", F.when(is_save, order)).alias("metrics"),
        F.count_if(is_save).alias("_saves"),
    ).filter("_saves > 0")
    promoted = staged.filter((F.col("action") == "stage") & (F.col("_stage") == "champion"))
    last_promotion = promoted.groupBy("model_id").agg(
        F.max_by("version", order).alias("_champion"), F.max(order).alias("_promoted")
    )
    joined = per_version.join(last_promotion, "model_id", "left")
    replaced = (
        (F.col("stage") == "champion") & (F.col("_champion") != F.col("version"))
        & (F.col("_promoted") > F.col("_latest"))
    )
    final = F.when(F.coalesce(replaced, F.lit(False)), F.lit("retired")).otherwise(F.col("stage"))
    return joined.withColumn("stage", final).select(
        "model_id", "version", "uri", "framework", "stage", "metrics",
        F.col("_latest")["at"].alias("changed_at"),
        (~F.col("stage").isin(INACTIVE_STAGES)).alias("is_active"),
    )


def champion(state: DataFrame) -> DataFrame:
    return state.filter(F.col("stage") == "champion")


def active(state: DataFrame, model_id: str | None = None) -> DataFrame:
    rows = state.filter("is_active")
    return rows if model_id is None else rows.filter(F.col("model_id") == model_id)


def by_id(state: DataFrame, model_id: str, version: str) -> DataFrame:
    return state.filter((F.col("model_id") == model_id) & (F.col("version") == version))


def listed(state: DataFrame) -> DataFrame:
    return state.filter("is_active").orderBy("model_id", "version")


def jobs(events: DataFrame) -> DataFrame:
    """Current state of each job with its start, end and duration."""
    terminal = F.col("status").isin("completed", "failed", "cancelled")
    folded = events.groupBy("job_id", "model_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("status"),
        F.min("at").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(terminal, F.col("at"))).alias("completed_at"),
    )
    seconds = (
        F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    ) / 1e6
    return folded.withColumn("duration_seconds", seconds)


def job_history(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest `limit` jobs of every model."""
    newest = [F.col("created_at").desc(), F.col("job_id")]
    return top_per_key(jobs(events), ["model_id"], newest, limit, "job_id", "position")


def latest_completed(events: DataFrame) -> DataFrame:
    """Last completed job of every model."""
    done = jobs(events).filter(F.col("status") == "completed")
    return done.groupBy("model_id").agg(
        F.max_by("job_id", F.struct("completed_at", "job_id")).alias("job_id"),
        F.max("completed_at").alias("completed_at"),
    )


def transition_audit(events: DataFrame) -> DataFrame:
    """Every status change with whether the job life cycle allows it. Jobs have few events each."""
    line = Window.partitionBy("job_id").orderBy("at", "seq")
    previous = F.lag("status").over(line)
    legal = F.lit(False)
    for status, before in ALLOWED_BEFORE.items():
        names = [b for b in before if b is not None]
        ok = F.col("previous").isin(names) if names else F.lit(False)
        if None in before:
            ok = ok | F.col("previous").isNull()
        legal = legal | ((F.col("status") == status) & F.coalesce(ok, F.lit(False)))
    return events.withColumn("previous", previous).select(
        "job_id", "seq", "status", "previous", legal.alias("legal")
    )


def runs_log(runs: DataFrame) -> DataFrame:
    """Run rows as stored: NaN metrics dropped, parameters cut to 250 characters, duration added."""
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp"))
               - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return runs.withColumns(
        {
            "metrics": F.map_filter("metrics", lambda k, v: v.isNotNull() & ~F.isnan(v)),
            "params": F.transform_values("params", lambda k, v: F.substring(v, 1, 250)),
            "duration_seconds": seconds,
        }
    )


def flatten_params(nested: dict, prefix: str = "") -> dict[str, str]:
    """Nested hyper-parameters as dotted names; values as text of at most 250 characters."""
    flat: dict[str, str] = {}
    for name, value in nested.items():
        key = f"{prefix}.{name}" if prefix else name
        flat.update(flatten_params(value, key) if isinstance(value, dict) else {key: str(value)[:250]})
    return flat


def runs_compare(runs: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Runs by a metric, best first; a missing metric sorts as 0."""
    value = F.try_element_at("metrics", F.lit(metric))
    return runs.select("run_id", "model_type", value.alias("metric"), "duration_seconds").orderBy(
        F.coalesce("metric", F.lit(0.0)).desc(), "run_id"
    )


def best_run(runs: DataFrame, keys: list[str], metric: str = "accuracy") -> DataFrame:
    """Best run per key; of equals the first id."""
    value = F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(0.0))
    # The first id of every metric value, then the one of the best value: two small aggregates, no join back.
    firsts = runs.withColumn("_m", value).groupBy(*keys, "_m").agg(F.min("run_id").alias("_id"))
    return firsts.groupBy(*keys).agg(F.max("_m").alias("best_metric"), F.max_by("_id", "_m").alias("run_id"))
