"""Two-sample drift statistics for every (model, feature) in one job.

Samples are long frames: the key columns, `value`, and `is_reference`. All four
methods return the same report columns, one row per key that has both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import config
from driftwell.functions.exact_ks import exact_ks_p_udf
from driftwell.functions.math import chi2_sf, ks_asymptotic_p
from driftwell.operators.smallside import join_small
from driftwell.operators.ordered import ecdf, ecdf_percentiles, top_per_key
from driftwell.operators.relabel import relabelled_p

KEYS = ["model_id", "feature_name"]
REPORT = ["feature_name", "drift_detected", "p_value", "statistic", "threshold", "method",
          "recommendation", "sample_size"]


def pair_samples(reference: DataFrame, current: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Put a reference and a current long frame into one sample frame."""
    def side(df: DataFrame, flag: bool) -> DataFrame:
        return df.select(*keys, F.col("value").cast("double").alias("value"), F.lit(flag).alias("is_reference"))

    return side(reference, True).unionByName(side(current, False))


def feature_samples(logs: DataFrame, is_reference: Column, features: str = "features") -> DataFrame:
    """Explode the feature vector of every log row; empty vectors give no rows.

    The outer form spares the emptiness test that the planner would put in front,
    which builds the vector a second time.
    """
    return logs.select(
        "model_id", is_reference.alias("is_reference"), F.posexplode_outer(features).alias("position", "value")
    ).filter("position IS NOT NULL").select(
        "model_id",
        F.concat(F.lit("feature_"), F.col("position")).alias("feature_name"),
        "value",
        "is_reference",
    )


def _counted(samples: DataFrame) -> DataFrame:
    return samples.withColumns(
        {
            "n_ref": F.when(F.col("is_reference"), 1).otherwise(0).cast("bigint"),
            "n_cur": F.when(F.col("is_reference"), 0).otherwise(1).cast("bigint"),
        }
    )


def _present(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def two_sample_ecdf(samples: DataFrame, keys: list[str] = KEYS, chunks: int | None = None) -> DataFrame:
    return ecdf(_counted(samples), keys, "value", ["n_ref", "n_cur"], chunks)


def recommendation(detected: Column, statistic: Column, feature: Column) -> Column:
    """Fixed texts users see; the critical cut applies to the raw statistic."""
    return (
        F.when(~detected, F.lit("No action needed. Distribution remains stable."))
        .when(
            statistic > config.CRITICAL_STATISTIC,
            F.concat(
                F.lit("CRITICAL: Severe drift in "),
                feature,
                F.lit(". Immediate retraining and pipeline check required."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("WARNING: Drift detected in "),
                feature,
                F.lit(". Scheduling auto-retraining pipeline."),
            )
        )
    )


def _report(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Finish a frame that already has statistic, p_value, threshold, drift_detected, n_cur."""
    feature = F.col("feature_name") if "feature_name" in keys else F.concat_ws("/", *keys)
    named = df.withColumns(
        {
            "method": F.lit(method),
            "recommendation": recommendation(F.col("drift_detected"), F.col("statistic"), feature),
            "sample_size": F.col("n_cur"),
        }
    )
    return named.select(*keys, *[c for c in REPORT if c not in keys])


def _ecdf_gap() -> Column:
    return F.abs(
        F.col("cum_n_ref") / F.col("tot_n_ref").cast("double")
        - F.col("cum_n_cur") / F.col("tot_n_cur").cast("double")
    )


def _both_sides() -> Column:
    return (F.col("tot_n_ref") > 0) & (F.col("tot_n_cur") > 0)


def ks(samples: DataFrame, keys: list[str] = KEYS, threshold: float = 0.05,
       p_method: str = "asymptotic", chunks: int | None = None) -> DataFrame:
    """Largest gap of the two empirical distributions.

    The p-value is the corrected limiting law at every size. `p_method="exact"` counts paths instead, for samples
    of at most EXACT_LIMIT rows a side (null beyond); such reports carry the method `ks_test_exact`.
    """
    stats = (
        two_sample_ecdf(samples, keys, chunks)
        .filter(_both_sides())
        .groupBy(*keys)
        .agg(
            F.max(_ecdf_gap()).alias("statistic"),
            F.max("tot_n_ref").alias("n_ref"),
            F.max("tot_n_cur").alias("n_cur"),
        )
    )
    if p_method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown p_method {p_method}")
    if p_method == "exact":
        stats = stats.withColumn("p_value", exact_ks_p_udf("statistic", "n_ref", "n_cur"))
    else:
        stats = stats.withColumn("p_value", ks_asymptotic_p(F.col("statistic"), F.col("n_ref"), F.col("n_cur")))
    done = stats.withColumns(
        {"threshold": F.lit(threshold), "drift_detected": F.col("p_value") < threshold}
    )
    return _report(done, keys, "ks_test" if p_method == "asymptotic" else "ks_test_exact")


def wasserstein(samples: DataFrame, keys: list[str] = KEYS, threshold: float = 0.05,
                chunks: int | None = None, relabelings: int = 0) -> DataFrame:
    """Area between the two empirical distributions, judged against half the reference spread.

    `threshold` is accepted for a uniform signature; the decision uses the spread. The p-value is null unless a number
    of `relabelings` of all rows is asked for (see `relabel`); it never enters the decision.
    """
    frame = two_sample_ecdf(samples, keys, chunks).filter(_both_sides())
    stats = frame.groupBy(*keys).agg(
        F.sum(
            _ecdf_gap() * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
        ).alias("statistic"),
        F.max("tot_n_ref").alias("n_ref"),
        F.max("tot_n_cur").alias("n_cur"),
    )
    spread = (
        _present(samples).filter("is_reference").groupBy(*keys)
        .agg((F.stddev_pop("value") * config.WASSERSTEIN_FACTOR).alias("threshold"))
    )
    done = stats.join(spread, keys).withColumns(
        {
            "drift_detected": F.col("statistic") > F.col("threshold"),
            "p_value": F.lit(None).cast("double"),
        }
    )
    if relabelings:
        drawn = relabelled_p(samples, keys, relabelings, chunks=chunks)
        done = join_small(done.drop("p_value"), drawn, keys)
    return _report(done, keys, "wasserstein")


def decile_edges(samples: DataFrame, keys: list[str] = KEYS, bins: int = config.HISTOGRAM_BINS,
                 chunks: int | None = None) -> DataFrame:
    """Interior bin edges e1..e9 per key: percentiles of the reference.

    The outer bins are open, so a percentile equal to the smallest or largest value is
    no edge (null). Equal edges leave an empty bin between them, which adds nothing.
    """
    reference = _present(samples).filter("is_reference").withColumn("_n", F.lit(1).cast("bigint"))
    frame = ecdf(reference, keys, "value", ["_n"], chunks)
    cuts = ecdf_percentiles(frame, keys, "value", "_n", {f"e{i}": i / bins for i in range(bins + 1)})
    return cuts.select(
        *keys, *[F.expr(f"CASE WHEN e{i} > e0 AND e{i} < e{bins} THEN e{i} END AS e{i}") for i in range(1, bins)]
    )


def _cells(binned: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Counts per bin as columns r0.. and c0.., one row per key.

    The first aggregate is combined per task, so the shuffle carries at most one row
    per (key, bin) and task, whatever the number of samples behind a key.
    """
    counts = binned.groupBy(*keys, "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))

    return counts.groupBy(*keys).agg(
        *[
            F.expr(f"coalesce(sum(CASE WHEN bin = {i} THEN {side} END), 0) AS {cell}{i}")
            for side, cell in (("n_ref", "r"), ("n_cur", "c"))
            for i in range(bins)
        ],
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_cur").alias("n_cur"),
    ).filter("n_ref > 0 AND n_cur > 0")


def psi(samples: DataFrame, keys: list[str] = KEYS, threshold: float = config.PSI_DRIFT,
        chunks: int | None = None) -> DataFrame:
    """Population stability index over reference deciles; the cut is fixed.

    The edge table has one row per key. It is measured and broadcast, so that bin counts are
    shuffled and not samples.
    """
    bins = config.HISTOGRAM_BINS
    edges = decile_edges(samples, keys, chunks=chunks)
    bin_no = " + ".join(f"CASE WHEN e{i} <= value THEN 1 ELSE 0 END" for i in range(1, bins))
    binned = join_small(_counted(_present(samples)), edges, keys, "inner").withColumn("bin", F.expr(bin_no))

    def share(count: str, total: str) -> str:
        return f"least(1D, greatest({config.PSI_EPSILON!r}D, {count} / {total}))"

    # Bin by bin: (current share - reference share) * log of their ratio.
    shares = [(share(f"r{i}", "n_ref"), share(f"c{i}", "n_cur")) for i in range(bins)]
    statistic = " + ".join(f"({cur} - {ref}) * ln({cur} / {ref})" for ref, cur in shares)
    done = _cells(binned, keys, bins).withColumn("statistic", F.expr(statistic)).withColumns(
        {
            "drift_detected": F.col("statistic") > config.PSI_DRIFT,
            "threshold": F.lit(config.PSI_DRIFT),
            "p_value": F.when(F.col("statistic") > config.PSI_DRIFT, F.lit(0.01))
            .when(F.col("statistic") > config.PSI_STABLE, F.lit(0.1))
            .otherwise(F.lit(0.5)),
        }
    )
    return _report(done, keys, "psi")


def equal_width_bins(samples: DataFrame, keys: list[str] = KEYS, bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """Low end and width of equal bins over both samples; a constant is widened by 0.5 each way."""
    spans = _present(samples).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    return spans.select(*keys, low.alias("lo"), ((high - low) / bins).alias("width"))


def chi2(samples: DataFrame, keys: list[str] = KEYS, threshold: float = 0.05,
         chunks: int | None = None) -> DataFrame:
    """Chi-square of smoothed counts over ten equal-width bins.

    Edge i is lo + i * width. The quotient gives the bin up to rounding, and comparing
    with the edges themselves settles it; the last bin includes its upper edge.
    """
    bins = config.HISTOGRAM_BINS
    settled = """CASE WHEN value < lo + guess * width THEN guess - 1
                      WHEN value >= lo + (guess + 1) * width THEN guess + 1 ELSE guess END"""
    binned = (
        join_small(_counted(_present(samples)), equal_width_bins(samples, keys), keys, "inner")
        .withColumn("guess", F.expr("floor((value - lo) / width)"))
        .withColumn("bin", F.expr(f"CAST(greatest(0, least({bins - 1}, {settled})) AS INT)"))
    )
    expected = [f"((r{i} + 1D) / (n_ref + {bins}) * (n_cur + {bins}))" for i in range(bins)]
    statistic = " + ".join(f"power(c{i} + 1D - {e}, 2) / {e}" for i, e in enumerate(expected))
    p_value = chi2_sf(F.col("statistic"), bins - 1)
    done = (
        _cells(binned, keys, bins).withColumn("statistic", F.expr(statistic)).withColumn("p_value", p_value)
        .withColumns({"threshold": F.lit(threshold), "drift_detected": F.col("p_value") < threshold})
    )
    return _report(done, keys, "chi2")


METHODS: dict[str, Callable[..., DataFrame]] = {"ks": ks, "psi": psi, "wasserstein": wasserstein, "chi2": chi2}


def drift(samples: DataFrame, method: str = "ks", keys: list[str] = KEYS, threshold: float = 0.05,
          **options) -> DataFrame:
    """Dispatch by method name; add a method by adding a function to METHODS."""
    if method not in METHODS:
        raise ValueError(f"Unsupported test type: '{method}'. Supported: {', '.join(sorted(METHODS))}")
    return METHODS[method](samples, keys=keys, threshold=threshold, **options)


def sample_problems(samples: DataFrame, keys: list[str] = KEYS, min_points: int = 1) -> DataFrame:
    """Keys that cannot be tested: an empty side, or too few current points."""
    sizes = _counted(_present(samples)).groupBy(*keys).agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )
    reason = (
        F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), F.lit("Data samples cannot be empty"))
        .when(
            F.col("n_cur") < min_points,
            F.format_string("Not enough data points (%d) to calculate drift", F.col("n_cur")),
        )
    )
    return sizes.withColumn("reason", reason).filter("reason IS NOT NULL")


def event_counts(reports: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Detected-drift events per key; keys without any show 0."""
    return reports.groupBy(*keys).agg(F.count_if("drift_detected").alias("drift_events"))


def latest_scores(reports: DataFrame) -> DataFrame:
    """Latest score per (model, feature, method)."""
    return reports.groupBy("model_id", "feature_name", "method").agg(
        F.max_by("statistic", "analyzed_at").alias("drift_score")
    )


def history(reports: DataFrame, limit: int = 100) -> DataFrame:
    """Latest `limit` reports of every model, newest first."""
    newest = [F.col("analyzed_at").desc(), F.col("feature_name"), F.col("method")]
    return top_per_key(reports, ["model_id"], newest, limit, "analyzed_at", "position")
