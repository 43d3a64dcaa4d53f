"""Dataset jobs: ingest with validation, and training data from labelled logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.operators.logs import labeled_logs
from driftwell.operators.quality import clean_basic, quality_issues, quality_summary
from driftwell.sources.tables import write_dataset


@dataclass
class Ingested:
    success: bool
    rows_processed: int
    rows_stored: int
    issues: DataFrame
    cleaned: DataFrame | None
    errors: list[str]


def ingest(source: DataFrame, target: str | None = None,
           ranges: dict[str, tuple[float, float]] | None = None, path: str | None = None,
           chunks: int | None = None) -> Ingested:
    """Validate, stop on errors, clean, and store when a path is given."""
    issues = quality_issues(source, target, ranges, chunks)
    verdict = quality_summary(source, issues).first()
    processed = int(verdict["total_rows"])
    if not verdict["passed"]:
        return Ingested(False, processed, 0, issues, None, [f"Validation failed: {verdict['error_count']} error(s)"])
    cleaned = clean_basic(source, chunks)
    if path is not None:
        write_dataset(cleaned, path)
    return Ingested(True, processed, cleaned.count(), issues, cleaned, [])


def fresh_training_rows(logs: DataFrame, width: int, baseline_columns: list[str] | None = None,
                        limit: int | None = None, model_id: str | None = None) -> DataFrame:
    """Labelled logs as columns: baseline names when the width matches, else feature_i. All of them, or the newest `limit`."""
    named = [c for c in (baseline_columns or []) if c != "target"]
    names = named if len(named) == width else [f"feature_{i}" for i in range(width)]
    rows = labeled_logs(logs, limit, model_id)
    return rows.select(
        *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)], F.col("target").alias("target")
    )


def export_training(logs: DataFrame, width: int, baseline: DataFrame | None = None,
                    limit: int | None = None, model_id: str | None = None) -> DataFrame:
    """Baseline rows followed by the labelled logs (all, or the newest `limit`); columns missing on one side are null."""
    fresh = fresh_training_rows(logs, width, baseline.columns if baseline is not None else None, limit, model_id)
    if baseline is None:
        return fresh.withColumn("origin", F.lit("fresh"))
    return baseline.withColumn("origin", F.lit("baseline")).unionByName(
        fresh.withColumn("origin", F.lit("fresh")), allowMissingColumns=True
    )


def require_samples(exported: DataFrame, min_samples: int = 500) -> dict[str, int]:
    """Sizes of an export in one count; an error when there are too few rows."""
    sizes = exported.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("origin") == "fresh").alias("fresh_samples"),
        F.count_if(F.col("origin") == "baseline").alias("baseline_samples"),
    ).first().asDict()
    if sizes["total_samples"] < min_samples:
        raise ValueError(
            f"Insufficient data: {sizes['total_samples']} samples (need {min_samples}). "
            f"Fresh: {sizes['fresh_samples']}, baseline: {sizes['baseline_samples']}."
        )
    return sizes
