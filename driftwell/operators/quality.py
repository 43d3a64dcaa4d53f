"""Dataset checks, profiles and cleaning.

All columns of a table are measured in one aggregate; nothing loops over columns
with a job each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import config
from driftwell.functions.text import fixed
from driftwell.operators.ordered import column_percentiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _stack(wide: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """One wide aggregate row to one row per column."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(r, names)]) for r in rows]
    return wide.select(F.inline(F.array(*structs)))


def _as_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly for equal values."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (value + F.lit(0.0).cast(kind)).cast("string")  # -0 is 0
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value)))
    return value.cast("string")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique_count): non-null distinct values of each column, all columns in one shuffle.

    Values are collapsed on the map side as (column, value), so a column with few values costs a few rows per task, and
    no row is carried once per column with everything else.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("at"), _as_text(df, c).alias("cell")) for i, c in enumerate(columns)])
    values = df.select(F.inline(cells)).filter("cell is not null").groupBy("at", "cell").agg(F.lit(1).alias("one"))
    return values.groupBy("at").agg(F.count("*").alias("unique_count"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, counts, null percent, distinct count, mean, std(sample), min and max per column."""
    columns = columns or df.columns
    clean = nan_to_null(df.select(*columns))
    numeric = set(numeric_columns(clean))
    measures: list[Column] = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        measures.append(F.count(c).alias(f"n_{i}"))
        if c in numeric:
            measures += [
                F.avg(c).alias(f"m_{i}"), F.stddev_samp(c).alias(f"s_{i}"),
                F.min(c).cast("double").alias(f"lo_{i}"), F.max(c).cast("double").alias(f"hi_{i}"),
            ]
    missing = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(columns):
        nulls = F.col("_rows") - F.col(f"n_{i}")
        number = c in numeric
        rows.append(
            [
                F.lit(i), F.lit(c), F.lit(df.schema[c].dataType.simpleString()), F.col(f"n_{i}"), nulls,
                F.round(F.coalesce(F.try_divide(nulls * 100.0, F.col("_rows")), F.lit(0.0)), 2),
                F.round(f"m_{i}", 4) if number else missing,
                F.round(f"s_{i}", 4) if number else missing,
                F.col(f"lo_{i}") if number else missing,
                F.col(f"hi_{i}") if number else missing,
            ]
        )
    names = ["_at", "column", "dtype", "non_null_count", "null_count", "null_percent", "mean", "std", "min_val", "max_val"]
    measured = _stack(clean.agg(*measures), rows, names)
    # Both sides have a row per column.
    joined = measured.join(F.broadcast(distinct_counts(clean, columns)), F.col("_at") == F.col("at"), "left")
    unique = F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count")
    return joined.select(*names[1:6], unique, *names[6:])


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    wide = df.agg(*[(F.avg(is_missing(df, c).cast("double")) * 100).alias(f"p_{i}") for i, c in enumerate(columns)])
    return _stack(wide, [[F.lit(c), F.col(f"p_{i}")] for i, c in enumerate(columns)], ["column", "null_pct"])


def overall_null_gate(df: DataFrame, min_rows: int = config.GATE_MIN_ROWS,
                      max_null_percent: float = config.GATE_MAX_NULL_PERCENT) -> DataFrame:
    """Rows, columns, percent of null cells, and whether the table may be trained on."""
    width = len(df.columns)
    nulls = sum((F.count_if(is_missing(df, c)) for c in df.columns[1:]), F.count_if(is_missing(df, df.columns[0])))
    totals = df.agg(F.count("*").alias("row_count"), nulls.alias("_nulls"))
    percent = F.round(F.coalesce(F.try_divide(F.col("_nulls") * 100.0, F.col("row_count") * width), F.lit(0.0)), 2)
    return totals.withColumn("null_percent", percent).select(
        "row_count", F.lit(width).cast("bigint").alias("column_count"), "null_percent",
        ((F.col("row_count") >= min_rows) & (F.col("null_percent") <= max_null_percent)).alias("validation_passed"),
    )


@dataclass
class Check:
    """A check that needs one scan: aggregates over the rows, and issues read off their result.

    Checks that are run together share the scan.
    """

    measures: list[Column]
    issues: list[Column]


def _issue(hit: Column, column: str, severity: Column | str, kind: Column | str, message: Column, value: Column,
           order: int) -> Column:
    severity, kind = (F.lit(x) if isinstance(x, str) else x for x in (severity, kind))
    return F.when(
        F.coalesce(hit, F.lit(False)),
        F.struct(
            F.lit(column).alias("column"), severity.alias("severity"), kind.alias("issue_type"),
            message.alias("message"), value.cast("double").alias("value"), F.lit(order).alias("check_order"),
        ),
    )


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One aggregate for all checks; a row per issue that holds."""
    measures = [m for check in checks for m in check.measures]
    issues = [i for check in checks for i in check.issues]
    return df.agg(*measures).select(F.explode(F.array(*issues)).alias("_i")).filter("_i IS NOT NULL").select("_i.*")


def empty_check() -> Check:
    """An ERROR when the dataset has no rows."""
    return Check(
        [F.count("*").alias("_rows")],
        [_issue(F.col("_rows") == 0, "*", "error", "empty_dataset", F.lit("Dataset has 0 rows"), F.lit(0.0), 0)],
    )


def null_check(df: DataFrame, max_null_percent: float = config.MAX_NULL_PERCENT) -> Check:
    """Any nulls warn; more than the limit is an error."""
    measures, issues = [], []
    for i, c in enumerate(df.columns):
        measures.append((F.avg(is_missing(df, c).cast("double")) * 100).alias(f"_null{i}"))
        percent = F.col(f"_null{i}")
        high = percent > max_null_percent
        message = F.concat(
            F.lit(f"{c} has "), fixed(percent, 1), F.lit("% null values"),
            F.when(high, F.lit(f" (threshold: {max_null_percent}%)")).otherwise(F.lit("")),
        )
        issues.append(
            _issue(
                percent > 0, c, F.when(high, F.lit("error")).otherwise(F.lit("warning")),
                F.when(high, F.lit("high_null_rate")).otherwise(F.lit("has_nulls")), message, F.round(percent, 2), 1,
            )
        )
    return Check(measures, issues)


def range_check(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> Check:
    """Values outside [lo, hi]; columns the table lacks are skipped."""
    measures, issues = [], []
    for i, (c, (lo, hi)) in enumerate((c, b) for c, b in ranges.items() if c in df.columns):
        measures.append(F.count_if(~is_missing(df, c) & ((F.col(c) < lo) | (F.col(c) > hi))).alias(f"_range{i}"))
        count = F.col(f"_range{i}")
        message = F.format_string(f"{c}: %d values outside [{lo}, {hi}]", count)
        issues.append(_issue(count > 0, c, "warning", "out_of_range", message, count, 4))
    return Check(measures, issues)


def target_check(df: DataFrame, target: str) -> Check:
    """Null targets are an error; so is a target with exactly one value.

    One value means smallest equals largest, which needs no distinct count.
    """
    present = F.when(~is_missing(df, target), F.col(target))
    nulls = F.col("_target_nulls")
    return Check(
        [
            F.count_if(is_missing(df, target)).alias("_target_nulls"),
            F.min(present).alias("_target_min"),
            F.max(present).alias("_target_max"),
        ],
        [
            _issue(nulls > 0, target, "error", "target_has_nulls", F.lit("Target column has null values"), nulls, 5),
            _issue(
                F.col("_target_min") == F.col("_target_max"), target, "error", "constant_target",
                F.lit("Target has only 1 unique value"), F.lit(1.0), 5,
            ),
        ],
    )


def check_empty(df: DataFrame) -> DataFrame:
    return run_checks(df, [empty_check()])


def check_nulls(df: DataFrame, max_null_percent: float = config.MAX_NULL_PERCENT) -> DataFrame:
    return run_checks(df, [null_check(df, max_null_percent)])


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return run_checks(df, [empty_check(), range_check(df, ranges)])


def check_target(df: DataFrame, target: str) -> DataFrame:
    return run_checks(df, [target_check(df, target)])


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group; nulls equal nulls, as grouping has it."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn(
        "duplicate_pct",
        F.coalesce(F.try_divide(F.col("duplicate_count") * 100.0, F.col("total_rows")), F.lit(0.0)),
    )


def check_duplicates(df: DataFrame, max_percent: float = config.MAX_DUPLICATE_PERCENT) -> DataFrame:
    return duplicate_counts(df).filter(F.col("duplicate_pct") > max_percent).select(
        F.lit("*").alias("column"), F.lit("warning").alias("severity"),
        F.lit("high_duplicates").alias("issue_type"),
        F.concat(
            F.format_string("Dataset has %d duplicate rows (", F.col("duplicate_count")),
            fixed(F.col("duplicate_pct"), 1), F.lit("%)"),
        ).alias("message"),
        F.round("duplicate_pct", 2).alias("value"), F.lit(2).alias("check_order"),
    )


def outlier_counts(df: DataFrame, columns: list[str] | None = None, factor: float = config.OUTLIER_IQR,
                   chunks: int | None = None) -> DataFrame:
    """Values outside q1 - f*IQR .. q3 + f*IQR per numeric column; columns with IQR 0 are skipped.

    Second pass: the bounds (one entry per column) are a scalar subquery, evaluated once;
    each column is then one conditional count of the same scan.
    """
    columns = columns or numeric_columns(df)
    clean = nan_to_null(df.select(*columns))
    quartiles = column_percentiles(clean, columns, {"q1": 0.25, "q3": 0.75}, chunks)
    bounds = quartiles.filter("q3 - q1 <> 0").select(
        "column",
        (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    limits = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("_b"))
    counted = clean.withColumn("_b", limits.scalar()).agg(
        *[
            F.count_if(
                (F.col(c) < F.try_element_at("_b", F.lit(c))["lower"])
                | (F.col(c) > F.try_element_at("_b", F.lit(c))["upper"])
            ).alias(f"o_{i}")
            for i, c in enumerate(columns)
        ]
    )
    per_column = _stack(counted, [[F.lit(c), F.col(f"o_{i}")] for i, c in enumerate(columns)], ["column", "outlier_count"])
    return bounds.join(per_column, "column")


def check_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = config.OUTLIER_IQR,
                   chunks: int | None = None) -> DataFrame:
    return outlier_counts(df, columns, factor, chunks).filter("outlier_count > 0").select(
        "column", F.lit("info").alias("severity"), F.lit("outliers_detected").alias("issue_type"),
        F.concat(
            F.col("column"), F.format_string(" has %d outlier(s)", F.col("outlier_count")),
            F.lit(f" beyond {factor}×IQR"),
        ).alias("message"),
        F.col("outlier_count").cast("double").alias("value"), F.lit(3).alias("check_order"),
    )


def quality_issues(df: DataFrame, target: str | None = None,
                   ranges: dict[str, tuple[float, float]] | None = None, chunks: int | None = None) -> DataFrame:
    """All issues of a dataset. An empty dataset yields that single error.

    Emptiness, nulls, ranges and the target share one scan; duplicates need a
    grouping and outliers the quartiles first, so those scan for themselves.
    """
    checks = [empty_check(), null_check(df)]
    if ranges:
        checks.append(range_check(df, ranges))
    if target and target in df.columns:
        checks.append(target_check(df, target))
    return (
        run_checks(df, checks)
        .unionByName(check_duplicates(df))
        .unionByName(check_outliers(df, chunks=chunks))
    )


def quality_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Totals and verdict: passed means no error."""
    counts = issues.agg(
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    return counts.withColumn("total_rows", df.agg(F.count("*")).scalar()).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), "issue_count", "error_count",
        "warning_count", (F.col("error_count") == 0).alias("passed"),
    )


def clean_basic(df: DataFrame, chunks: int | None = None) -> DataFrame:
    """Drop rows that are entirely null, then fill numeric nulls with the exact median of what is left.

    Fills columns of type double, float and bigint, whose medians are computed together.
    """
    kept = nan_to_null(df).dropna("all")
    fillable = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType))
    ]
    if not fillable:
        return kept
    medians = column_percentiles(kept, fillable, {"median": 0.5}, chunks)
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("_m"))
    return kept.withColumn("_m", table.scalar()).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_m", F.lit(c))) for c in fillable}
    ).drop("_m")
