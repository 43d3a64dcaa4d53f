"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import drift as D
from driftwell.operators.store import reference_snapshot as snapshot
from driftwell.plans import views
from driftwell.plans.catalog.base import LOGS, SAMPLES, advice_sql, ecdf_sql, erf_sql, query
from driftwell.plans.checks import ModelConfig, drift_all_models, drift_check
from driftwell.session import scratch_path
from driftwell.sources.tables import append_reports, table

KEYS = ["model_id", "feature_name"]
K = "model_id, feature_name"


def samples(spark, d):
    return D.feature_samples(views.prediction_logs(spark, d), views.is_reference())


# Large-sample KS p-value from d, n, m.
KS_P = """(CASE WHEN d <= 0 THEN 1.0e0 WHEN lam < 0.2 THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0, 2 * list_sum(list_transform(range(1, 101),
  lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0e0 * j * j * lam * lam))))) END)"""


def ks_sql(source: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    return f"""{ecdf_sql(source, keys, name + "_e")},
{name}_d AS (SELECT {k}, max(abs(ca / ta - cb / tb)) AS d, max(ta) AS n, max(tb) AS m FROM {name}_e WHERE ta > 0 AND tb > 0 GROUP BY {k}),
{name}_z AS (SELECT *, d * sqrt(greatest(1, round(n * m / (n + m)))) AS z0, greatest(1, round(n * m / (n + m))) AS ne FROM {name}_d),
{name}_l AS (SELECT *, z0 + 1 / (6 * sqrt(ne)) + (z0 - 1) / (4 * ne) AS lam FROM {name}_z),
{name} AS (SELECT {k}, d AS statistic, {KS_P} AS p, CAST(m AS BIGINT) AS sample_size FROM {name}_l)"""


def wasserstein_sql(source: str, name: str) -> str:
    return f"""{ecdf_sql(source, KEYS, name + "_e")},
{name} AS (SELECT {K}, sum(abs(ca / ta - cb / tb) * coalesce(nv - v, 0)) AS statistic, CAST(max(tb) AS BIGINT) AS sample_size
  FROM {name}_e WHERE ta > 0 AND tb > 0 GROUP BY {K}),
{name}_t AS (SELECT {K}, stddev_pop(value) * 0.5e0 AS threshold FROM {source} WHERE is_ref GROUP BY {K})"""


def psi_sql(source: str, name: str) -> str:
    return f"""{name}_q AS (SELECT {K}, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q
  FROM {source} WHERE is_ref GROUP BY {K}),
{name}_i AS (SELECT {K}, CASE WHEN len(q) > 2 THEN q[2:len(q) - 1] ELSE CAST([] AS DOUBLE[]) END AS edges FROM {name}_q),
{name}_c AS (SELECT {K}, len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c
  FROM {source} JOIN {name}_i USING ({K}) GROUP BY ALL),
{name}_g AS (SELECT {K}, unnest(range(0, len(edges) + 1)) AS bin FROM {name}_i),
{name}_s AS (SELECT {K}, greatest(1e-10, coalesce(r, 0) / sum(r) OVER (PARTITION BY {K})) AS ps, greatest(1e-10, coalesce(c, 0) / sum(c) OVER (PARTITION BY {K})) AS pc,
  sum(c) OVER (PARTITION BY {K}) AS tc FROM {name}_g LEFT JOIN {name}_c USING ({K}, bin)),
{name} AS (SELECT {K}, sum((pc - ps) * ln(pc / ps)) AS statistic, CAST(max(tc) AS BIGINT) AS sample_size FROM {name}_s GROUP BY {K})"""


def chi2_sql(source: str, name: str) -> str:
    odd = " + ".join(f"pow(x / 2, {i}) / gamma({i} + 1.5e0)" for i in range(4))
    return f"""{name}_r AS (SELECT {K}, min(value) AS lo0, max(value) AS hi0 FROM {source} GROUP BY {K}),
{name}_b AS (SELECT {K}, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM {name}_r),
{name}_i AS (SELECT {K}, list_transform(range(1, 10), lambda i: lo + i * ((hi - lo) / 10)) AS edges FROM {name}_b),
{name}_c AS (SELECT {K}, len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c
  FROM {source} JOIN {name}_i USING ({K}) GROUP BY ALL),
{name}_g AS (SELECT {K}, unnest(range(0, 10)) AS bin FROM {name}_i),
{name}_s AS (SELECT {K}, coalesce(r, 0) + 1 AS r, coalesce(c, 0) + 1 AS o, coalesce(c, 0) AS c FROM {name}_g LEFT JOIN {name}_c USING ({K}, bin)),
{name}_x AS (SELECT {K}, c, o, r / sum(r) OVER (PARTITION BY {K}) * sum(o) OVER (PARTITION BY {K}) AS e FROM {name}_s),
{name}_y AS (SELECT {K}, sum((o - e) * (o - e) / e) AS x, CAST(sum(c) AS BIGINT) AS sample_size FROM {name}_x GROUP BY {K}),
{name} AS (SELECT {K}, x AS statistic, sample_size,
  least(1.0e0, greatest(0.0e0, 1 - {erf_sql("sqrt(x / 2)")} + exp(-x / 2) * sqrt(x / 2) * ({odd}))) AS p FROM {name}_y)"""


BASE = f"WITH {LOGS}, {SAMPLES}"
KS_SELECT = f"""SELECT {K}, p < 0.05 AS drift_detected, round(p, 6) AS p_value, round(statistic, 6) AS statistic, 0.05e0 AS threshold, 'ks_test' AS method,
{advice_sql("p < 0.05", "statistic")} AS recommendation, sample_size FROM ks"""
W_SELECT = f"""SELECT {K}, statistic > threshold AS drift_detected, CAST(NULL AS DOUBLE) AS p_value, round(statistic, 6) AS statistic, round(threshold, 6) AS threshold,
'wasserstein' AS method, {advice_sql("statistic > threshold", "statistic")} AS recommendation, sample_size FROM w JOIN w_t USING ({K})"""
PSI_SELECT = f"""SELECT {K}, statistic > 0.25 AS drift_detected, CASE WHEN statistic > 0.25 THEN 0.01e0 WHEN statistic > 0.1 THEN 0.1e0 ELSE 0.5e0 END AS p_value, round(statistic, 6) AS statistic, 0.25e0 AS threshold, 'psi' AS method,
{advice_sql("statistic > 0.25", "statistic")} AS recommendation, sample_size FROM psi"""
CHI2_SELECT = f"""SELECT {K}, p < 0.05 AS drift_detected, round(p, 6) AS p_value, round(statistic, 6) AS statistic, 0.05e0 AS threshold, 'chi2' AS method,
{advice_sql("p < 0.05", "statistic")} AS recommendation, sample_size FROM chi2"""
COLUMNS = [*KEYS, "drift_detected", "p_value", "statistic", "threshold", "method", "recommendation", "sample_size"]


@query("drift_ks", f"{BASE}, {ks_sql('samples', KEYS, 'ks')} {KS_SELECT}")
def drift_ks(spark, d):
    return D.ks(samples(spark, d)).select(*COLUMNS)


@query("drift_ks_asymptotic", f"""{BASE}, {ks_sql('samples', KEYS, 'ks')}
SELECT {K}, round(statistic, 6) AS statistic, round(p, 6) AS p_value, sample_size FROM ks""")
def drift_ks_asymptotic(spark, d):
    return D.ks(samples(spark, d)).select(*KEYS, "statistic", "p_value", "sample_size")


@query("drift_psi", f"""{BASE}, {psi_sql('samples', 'psi')} SELECT {K}, statistic > 0.25 AS drift_detected,
CASE WHEN statistic > 0.25 THEN 0.01e0 WHEN statistic > 0.1 THEN 0.1e0 ELSE 0.5e0 END AS p_value, round(statistic, 6) AS statistic, 0.25e0 AS threshold,
'psi' AS method, {advice_sql("statistic > 0.25", "statistic")} AS recommendation, sample_size FROM psi""")
def drift_psi(spark, d):
    return D.psi(samples(spark, d))


@query("drift_wasserstein", f"{BASE}, {wasserstein_sql('samples', 'w')} {W_SELECT}")
def drift_wasserstein(spark, d):
    return D.wasserstein(samples(spark, d)).select(*COLUMNS)


@query("drift_wasserstein_relabelled", f"""{BASE}, {wasserstein_sql('samples', 'w')} SELECT {K}, statistic > threshold AS drift_detected,
round(statistic, 6) AS statistic, round(threshold, 6) AS threshold, true AS p_known, sample_size FROM w JOIN w_t USING ({K})""")
def drift_wasserstein_relabelled(spark, d):
    report = D.wasserstein(samples(spark, d), relabelings=200)
    return report.select(*KEYS, "drift_detected", "statistic", "threshold", F.col("p_value").between(0, 1).alias("p_known"), "sample_size")


@query("drift_chi2", f"""{BASE}, {chi2_sql('samples', 'chi2')} SELECT {K}, p < 0.05 AS drift_detected, round(p, 6) AS p_value,
round(statistic, 6) AS statistic, 0.05e0 AS threshold, 'chi2' AS method, {advice_sql("p < 0.05", "statistic")} AS recommendation, sample_size FROM chi2""")
def drift_chi2(spark, d):
    return D.chi2(samples(spark, d))


CONFIGS = [
    ModelConfig("m0", "classification"),
    ModelConfig("m1", "regression"),
    ModelConfig("m2", "image"),
]

SIDE_ALL = f"""{BASE}, s0 AS (SELECT * FROM samples WHERE model_id = 'm0'), s1 AS (SELECT * FROM samples WHERE model_id = 'm1'),
s2 AS (SELECT * FROM samples WHERE model_id = 'm2'), {ks_sql('s0', KEYS, 'ks')}, {wasserstein_sql('s1', 'w')}, {chi2_sql('s2', 'chi2')}
{KS_SELECT} UNION ALL {W_SELECT} UNION ALL {CHI2_SELECT}"""


@query("drift_all_models", SIDE_ALL)
def drift_all(spark, d):
    return drift_all_models(samples(spark, d), CONFIGS).select(*COLUMNS)


# The stored reference is everything before the cut; the current side is all logs.
RECENT = f"""WITH {LOGS}, recent AS (SELECT * FROM logs),
both_ AS (SELECT model_id, f0, f1, f2, true AS is_ref FROM logs WHERE is_ref UNION ALL SELECT model_id, f0, f1, f2, false FROM recent),
samples AS (SELECT model_id, 'feature_0' AS feature_name, f0 AS value, is_ref FROM both_ UNION ALL SELECT model_id, 'feature_1', f1, is_ref FROM both_
  UNION ALL SELECT model_id, 'feature_2', f2, is_ref FROM both_)"""


def stored_reference(spark, d):
    return samples(spark, d).filter("is_reference").select("model_id", "feature_name", "value")


@query("drift_check", RECENT + SIDE_ALL[len(BASE):])
def check(spark, d):
    return drift_check(stored_reference(spark, d), views.prediction_logs(spark, d), CONFIGS).select(*COLUMNS)


@query("drift_recommendation", f"""{BASE}, {psi_sql('samples', 'psi')}, cuts AS (SELECT unnest([0.0e0, 0.0005e0, 0.005e0, 1.0e0]) AS cut)
SELECT {K}, cut, {advice_sql("statistic > cut", "statistic * 300")} AS recommendation FROM psi, cuts""")
def drift_recommendation(spark, d):
    scores = D.psi(samples(spark, d)).select(*KEYS, "statistic")
    cuts = scores.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in (0.0, 0.0005, 0.005, 1.0)])))
    text = D.recommendation(F.col("statistic") > F.col("cut"), F.col("statistic") * 300, F.col("feature_name"))
    return cuts.select(*KEYS, "cut", text.alias("recommendation"))


# Week over week: every week is the current side of itself and the reference of the next.
WEEKLY = f"""{BASE}, weekly AS (
  SELECT model_id, feature_name, value, CAST(floor(epoch(created_at) / 604800) AS BIGINT) + s AS week, s = 1 AS is_ref
  FROM (SELECT model_id, 'feature_0' AS feature_name, f0 AS value, created_at FROM logs UNION ALL SELECT model_id, 'feature_1', f1, created_at FROM logs
    UNION ALL SELECT model_id, 'feature_2', f2, created_at FROM logs) x, (SELECT unnest([0, 1]) AS s) y),
{ks_sql('weekly', ['model_id', 'feature_name', 'week'], 'ks')}"""


def weekly_reports(spark, d):
    week = F.floor(F.unix_timestamp(F.col("created_at").cast("timestamp")) / 604800).cast("bigint")
    long = views.prediction_logs(spark, d).select(
        "model_id", F.posexplode("features").alias("p", "value"), week.alias("w")
    ).select(
        "model_id", F.concat(F.lit("feature_"), "p").alias("feature_name"), "value",
        F.inline(
            F.array(
                F.struct(F.col("w").alias("week"), F.lit(False).alias("is_reference")),
                F.struct((F.col("w") + 1).alias("week"), F.lit(True).alias("is_reference")),
            )
        ),
    )
    reports = D.ks(long, ["model_id", "feature_name", "week"], threshold=0.05)
    return reports.withColumn("analyzed_at", F.col("week") * 604800)


@query("drift_history", f"""{WEEKLY}, h AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY week DESC, feature_name) AS position FROM ks)
SELECT model_id, feature_name, week, round(statistic, 6) AS statistic, p < 0.05 AS drift_detected, CAST(position AS INTEGER) AS position FROM h WHERE position <= 5""")
def drift_history(spark, d):
    return D.history(weekly_reports(spark, d), 5).select(
        "model_id", "feature_name", "week", "statistic", "drift_detected", "position"
    )


@query("sink_drift_report", f"""{WEEKLY} SELECT model_id, feature_name, week, round(statistic, 6) AS statistic, sample_size FROM ks""")
def sink_drift_report(spark, d):
    path = scratch_path(spark, "drift_reports")
    append_reports(weekly_reports(spark, d), path)
    return spark.read.parquet(path).select("model_id", "feature_name", "week", "statistic", "sample_size")


@query("drift_event_count", f"""{WEEKLY} SELECT model_id, feature_name, count(*) FILTER (WHERE p < 0.05) AS drift_events FROM ks GROUP BY ALL""")
def drift_event_count(spark, d):
    return D.event_counts(weekly_reports(spark, d))


@query("drift_events_total", f"""{WEEKLY} SELECT model_id, count(*) FILTER (WHERE p < 0.05) AS drift_events FROM ks GROUP BY ALL""")
def drift_events_total(spark, d):
    return D.event_counts(weekly_reports(spark, d), ["model_id"])


@query("drift_score_gauge", f"""{WEEKLY} SELECT model_id, feature_name, 'ks_test' AS method, round(arg_max(statistic, week), 6) AS drift_score FROM ks GROUP BY ALL""")
def drift_score_gauge(spark, d):
    return D.latest_scores(weekly_reports(spark, d))


@query("drift_sample_problems", f"""{BASE}, f AS (SELECT * FROM samples WHERE NOT (model_id = 'm0' AND is_ref) AND NOT (model_id = 'm1' AND NOT is_ref)),
n AS (SELECT {K}, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM f GROUP BY ALL)
SELECT *, CASE WHEN n_ref = 0 OR n_cur = 0 THEN 'Data samples cannot be empty' ELSE 'Not enough data points (' || n_cur || ') to calculate drift' END AS reason
FROM n WHERE n_ref = 0 OR n_cur = 0 OR n_cur < 5""")
def drift_sample_problems(spark, d):
    gaps = ~((F.col("model_id") == "m0") & F.col("is_reference")) & ~(
        (F.col("model_id") == "m1") & ~F.col("is_reference")
    )
    return D.sample_problems(samples(spark, d).filter(gaps), min_points=5)


@query("reference_snapshot", """SELECT 'house-price' AS model_id, 'v1' AS version, 'p_size' AS feature_name, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT 'house-price', 'v1', 'p_retailprice', p_retailprice FROM part""")
def reference_snapshot(spark, d):
    return snapshot(table(spark, d, "part"), ["p_size", "p_retailprice"], "house-price", "v1")
