"""Aggregates over logs and labelled predictions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.abtest import rank_sums
from driftwell.operators.logs import recent_logs
from driftwell.operators.ordered import ecdf, percentiles


def model_performance(logs: DataFrame, models: DataFrame | None = None,
                      limit: int | None = None) -> DataFrame:
    """Count, mean latency (2 digits) and mean confidence (4) per model, of all logs or the newest `limit`.

    With `models`, a model without logs shows 0 and nulls.
    """
    stats = (logs if limit is None else recent_logs(logs, limit)).groupBy("model_id").agg(
        F.count("*").alias("total_predictions"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )
    if models is None:
        return stats
    known = models.select("model_id").distinct()
    return known.join(stats, "model_id", "left").fillna(0, ["total_predictions"])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, keys: list[str], truth: str = "ground_truth",
                           pred: str = "result") -> DataFrame:
    """Accuracy; precision, recall and F1 of class 1, each 0 when undefined."""
    y, p = F.col(truth), F.col(pred)
    counts = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    scored = counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(*keys, "n", "accuracy", "precision", "recall", f1.alias("f1_score"))


Measure = Callable[[Column, Column], Column]


def custom_metrics(df: DataFrame, measures: Mapping[str, Mapping[str, Measure]], key: str = "model_id",
                   truth: str = "ground_truth", pred: str = "result") -> DataFrame:
    """(key, metric, value, n) of the measures registered per model; the entry "*" holds for models without their own.

    A measure gets the truth and the prediction as columns and gives an aggregate. All models are measured in one
    aggregate: a measure sees the pairs of its own models only, null for all others, which aggregates pass over.
    """
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    present = df.filter(y.isNotNull() & p.isNotNull())
    own = [m for m in measures if m != "*"]
    columns, cells = [], []
    for m, named in measures.items():
        mine = ~F.col(key).isin(own) if m == "*" else F.col(key) == m
        for name, measure in named.items():
            at = f"_m{len(columns)}"
            columns.append(measure(F.when(mine, y), F.when(mine, p)).cast("double").alias(at))
            cells.append(F.when(mine, F.struct(F.lit(name).alias("metric"), F.col(at).alias("value"))))
    wide = present.groupBy(key).agg(F.count("*").alias("n"), *columns)
    listed = wide.select(key, "n", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return listed.select(key, "cell.metric", "cell.value", "n")


def regression_metrics(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """RMSE, MAE, R2 (0 for a constant truth) and MAPE in percent over non-zero truths."""
    y = F.col(truth).cast("double")
    error = y - F.col(pred).cast("double")
    present = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    sums = present.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("spread"),
        F.avg(F.when(y != 0, F.abs(error / F.when(y != 0, y)))).alias("relative"),
    )
    return sums.select(
        *keys, "n",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(F.lit(0.0)).alias("r2"),
        F.coalesce(F.col("relative") * 100, F.lit(0.0)).alias("mape"),
    )


def confusion_matrix(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    return df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(
        *keys, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")
    ).agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, plus macro and weighted F1.

    Everything after the confusion counts is classes x classes in size.
    """
    cells = confusion_matrix(df, keys, truth, pred)
    sides = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("label"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                ),
            )
        ),
    )
    classes = sides.groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    ).withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
        }
    ).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    whole = Window.partitionBy(*keys)
    return classes.select(
        *keys, "label", "precision", "recall", "f1", "support",
        F.avg("f1").over(whole).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")).over(whole) / F.sum("support").over(whole)).alias("f1_weighted"),
    )


def roc_auc(df: DataFrame, keys: list[str], truth: str, score: str, chunks: int | None = None) -> DataFrame:
    """Area under the ROC curve by the rank sum of the positives; ties count half."""
    labelled = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    ranks = rank_sums(labelled, keys, score, F.col(truth) == 1, chunks)
    area = F.try_divide(F.col("u"), F.col("n1").cast("double") * F.col("n2"))
    return ranks.select(*keys, F.col("n1").alias("positives"), F.col("n2").alias("negatives"), area.alias("auc"))


def roc_curve(df: DataFrame, keys: list[str], truth: str, score: str, chunks: int | None = None) -> DataFrame:
    """One point per distinct score: rates when everything at or above it is called positive."""
    labelled = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(
        *keys,
        F.col(score).alias("threshold"),
        (F.col(truth) == 1).cast("bigint").alias("pos"),
        (F.col(truth) != 1).cast("bigint").alias("neg"),
    )
    frame = ecdf(labelled, keys, "threshold", ["pos", "neg"], chunks)

    def rate(c: str) -> Column:
        at_or_above = F.col(f"tot_{c}") - F.col(f"cum_{c}") + F.col(c)
        return _ratio(at_or_above, F.col(f"tot_{c}"))

    return frame.select(*keys, "threshold", rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def latency_summary(logs: DataFrame, keys: list[str], at: str = "created_at",
                    chunks: int | None = None) -> DataFrame:
    """min/p50/p95/p99/max/mean/std(population) and requests per second of the covered span."""
    seconds = (
        F.max(F.unix_micros(F.col(at).cast("timestamp"))) - F.min(F.unix_micros(F.col(at).cast("timestamp")))
    ) / 1e6
    basic = logs.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.min("latency_ms").alias("min"),
        F.max("latency_ms").alias("max"),
        F.avg("latency_ms").alias("mean"),
        F.stddev_pop("latency_ms").alias("std"),
        F.try_divide(F.count("*"), seconds).alias("rps"),
    )
    cuts = percentiles(logs, keys, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, chunks)
    joined = basic.join(cuts, keys)
    return joined.select(
        *keys, "requests", *[F.round(c, 2).alias(c) for c in ("min", "p50", "p95", "p99", "max", "mean", "std")],
        F.round("rps", 6).alias("rps"),
    )


def class_balance(df: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Weight of the positive class: negatives / max(positives, 1)."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(target) == 0).alias("n_neg"), F.count_if(F.col(target) == 1).alias("n_pos")
    ).withColumn("pos_weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)).cast("double"))


def traffic_split(assigned: DataFrame, keys: list[str], role: str = "role") -> DataFrame:
    """Requests per role and their share within the key."""
    counts = assigned.groupBy(*keys, role).agg(F.count("*").alias("requests"))
    share = F.col("requests") / F.sum("requests").over(Window.partitionBy(*keys))
    return counts.withColumn("share", share)


def label_rate(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of rows that carry a label."""
    return logs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count("ground_truth").alias("labelled"),
        (F.count("ground_truth") * 100.0 / F.count("*")).alias("label_rate"),
    )


def batch_summary(scored: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Total, successful and failed rows per batch, with failures grouped by message.

    Row-level errors stay a table (`batch_errors`), since a batch may fail everywhere.
    """
    failed = F.col(error).isNotNull()
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(~failed).alias("successful"),
        F.count_if(failed).alias("failed"),
    )


def batch_errors(scored: DataFrame, keys: list[str], index: str, error: str = "error") -> DataFrame:
    return scored.filter(F.col(error).isNotNull()).select(*keys, F.col(index).alias("index"), error)


def prediction_counter(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Success and error counts; confidence is averaged over successes only."""
    ok = F.col("status") == "success"
    return logs.groupBy(*keys).agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        F.avg(F.when(ok, F.col("confidence"))).alias("success_confidence"),
    )
