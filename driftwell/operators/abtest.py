"""A/B comparison of a control and a variant group for every key at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.functions.math import chi2_cdf1, two_sided_normal_p
from driftwell.operators.ordered import ecdf


def advice(significant: Column, variant_better: Column, effect: Column) -> Column:
    """Fixed texts, checked in this order."""
    large = effect > config.AB_LARGE
    return (
        F.when(~significant, F.lit("No significant difference. Continue testing or keep control."))
        .when(
            effect < config.AB_NEGLIGIBLE,
            F.lit("Statistically significant but negligible effect. Keep control."),
        )
        .when(variant_better & large, F.lit("Strong evidence: promote variant to production."))
        .when(variant_better, F.lit("Moderate evidence: consider promoting variant."))
        .when(large, F.lit("Strong evidence: variant is worse. Keep control."))
        .otherwise(F.lit("Moderate evidence: variant may be worse. Keep control."))
    )


def rank_sums(df: DataFrame, keys: list[str], value: str, is_first: Column,
              chunks: int | None = None) -> DataFrame:
    """Sizes and rank-sum statistic U of the first group; ties share their average rank."""
    counted = df.select(
        *keys,
        F.col(value).cast("double").alias("_v"),
        F.when(is_first, 1).otherwise(0).cast("bigint").alias("a"),
        F.when(is_first, 0).otherwise(1).cast("bigint").alias("b"),
    )
    frame = ecdf(counted, keys, "_v", ["a", "b"], chunks)
    below = (F.col("cum_a") + F.col("cum_b") - F.col("a") - F.col("b")).cast("double")
    rank = below + (F.col("a") + F.col("b") + 1) / F.lit(2.0)
    sums = frame.groupBy(*keys).agg(
        F.sum(F.col("a") * rank).alias("_r"), F.max("tot_a").alias("n1"), F.max("tot_b").alias("n2")
    )
    n1 = F.col("n1").cast("double")
    return sums.select(*keys, "n1", "n2", (F.col("_r") - n1 * (n1 + 1) / 2).alias("u"))


def compare_means(df: DataFrame, keys: list[str], value: str, is_control: Column,
                  confidence: float = config.AB_CONFIDENCE, chunks: int | None = None) -> DataFrame:
    """Mann-Whitney U with a normal approximation, and Cohen's d. Needs at least one key column."""
    control = F.when(is_control, F.col(value))
    variant = F.when(~is_control, F.col(value))
    moments = df.groupBy(*keys).agg(
        F.avg(control).alias("control_mean"),
        F.avg(variant).alias("variant_mean"),
        F.stddev_samp(control).alias("_s1"),
        F.stddev_samp(variant).alias("_s2"),
    )
    ranks = rank_sums(df, keys, value, is_control, chunks)
    both = ranks.join(moments, keys)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    z = F.when(sigma > 0, F.abs(F.col("u") - n1 * n2 / 2) / sigma)
    pooled = F.sqrt((F.col("_s1") ** 2 + F.col("_s2") ** 2) / 2)
    gap = F.abs(F.col("control_mean") - F.col("variant_mean"))
    scored = both.withColumns(
        {
            "z": z,
            "p_value": F.coalesce(two_sided_normal_p(z), F.lit(1.0)),
            "effect_size": F.when(pooled > 0, gap / pooled).otherwise(F.lit(0.0)),
        }
    )
    return _decide(scored, keys, confidence, "mann_whitney_u", "z")


def compare_proportions(df: DataFrame, keys: list[str], confidence: float = config.AB_CONFIDENCE) -> DataFrame:
    """2x2 chi-square without continuity correction, and Cohen's h.

    Input columns: control_successes, control_total, variant_successes, variant_total.
    """
    s1, n1, s2, n2 = (
        F.col(c).cast("double")
        for c in ("control_successes", "control_total", "variant_successes", "variant_total")
    )
    total = n1 + n2

    def cell(observed: Column, size: Column, margin: Column) -> Column:
        expected = F.try_divide(size * margin, total)
        return F.when(expected > 0, (observed - expected) ** 2 / expected).otherwise(F.lit(0.0))

    hits, misses = s1 + s2, (n1 - s1) + (n2 - s2)
    chi = cell(s1, n1, hits) + cell(n1 - s1, n1, misses) + cell(s2, n2, hits) + cell(n2 - s2, n2, misses)
    p1, p2 = (F.coalesce(F.try_divide(s, n), F.lit(0.0)) for s, n in ((s1, n1), (s2, n2)))
    scored = df.withColumns(
        {
            "control_mean": p1,
            "variant_mean": p2,
            "n1": F.col("control_total"),
            "n2": F.col("variant_total"),
            "chi2": F.when(total > 0, chi),
            "p_value": F.when(total > 0, F.lit(1.0) - chi2_cdf1(chi)).otherwise(F.lit(1.0)),
            "effect_size": F.abs(2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))),
        }
    )
    return _decide(scored, keys, confidence, "chi_squared", "chi2")


def _decide(df: DataFrame, keys: list[str], confidence: float, method: str, statistic: str) -> DataFrame:
    significant = F.col("p_value") < (1.0 - confidence)
    return df.withColumn("is_significant", significant).select(
        *keys,
        "control_mean", "variant_mean",
        F.col("n1").alias("control_count"), F.col("n2").alias("variant_count"),
        F.col(statistic).alias("statistic"),
        "p_value", "is_significant", "effect_size",
        F.lit(confidence).alias("confidence_level"),
        advice(
            F.col("is_significant"), F.col("variant_mean") > F.col("control_mean"), F.col("effect_size")
        ).alias("recommendation"),
        F.lit(method).alias("test_method"),
    )


def report(result: DataFrame, keys: list[str], test_name: str = "model_comparison",
           control_name: str = "champion", variant_name: str = "challenger") -> DataFrame:
    """Presentation form: means and effect to 4 digits, p-value to 6."""
    return result.select(
        *keys,
        F.lit(test_name).alias("test_name"),
        F.lit(control_name).alias("control"),
        F.lit(variant_name).alias("variant"),
        F.round("control_mean", 4).alias("control_mean"),
        F.round("variant_mean", 4).alias("variant_mean"),
        "control_count", "variant_count",
        F.round("p_value", 6).alias("p_value"),
        "is_significant",
        F.round("effect_size", 4).alias("effect_size"),
        "recommendation",
    )
