"""Registry of the runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Engines sum in different orders, so doubles are compared after rounding; -0 becomes 0."""
    scale = 10.0**digits

    def near(c: str) -> Column:
        x = F.col(c)
        rounded_up = F.floor(F.abs(x) * scale + 0.5) / scale
        whole = F.when(F.abs(x) < 1e12, F.when(x < 0, -rounded_up).otherwise(rounded_up)).otherwise(x)
        return whole + F.lit(0.0)

    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: near(c) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, digits: int | None = 6) -> Callable[[Query], Query]:
    """Register a query. `digits` rounds its double columns; the SQL rounds by itself."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(tune(spark), folder)
            return result if digits is None else rounded(result, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# Shared SQL views. `k` is the counter inside the JSON properties.
LOGS = """logs AS (
  SELECT event_id AS id, 'm' || CAST(user_id % 3 AS VARCHAR) AS model_id,
         CASE WHEN event_id % 10 = 0 THEN 'v2' ELSE 'v1' END AS model_version,
         value AS f0, CAST(k AS DOUBLE) AS f1, CAST(hour(ts) AS DOUBLE) AS f2,
         CAST(k % 2 AS DOUBLE) AS result, 0.5e0 + k / 200.0e0 AS confidence, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'purchase' THEN 1.0e0 WHEN event_type = 'view' THEN 0.0e0 END AS ground_truth,
         ts AS created_at, user_id AS entity_id, event_type, k,
         ts < TIMESTAMP '2024-01-16' AS is_ref
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events) e
)"""

SAMPLES = """samples AS (
  SELECT model_id, 'feature_0' AS feature_name, f0 AS value, is_ref FROM logs
  UNION ALL SELECT model_id, 'feature_1', f1, is_ref FROM logs
  UNION ALL SELECT model_id, 'feature_2', f2, is_ref FROM logs
)"""

# erf as a series with positive terms only; at 6 and beyond it is 1 in double precision.
ERF = """(CASE WHEN abs({x}) >= 6 THEN sign({x}) ELSE sign({x}) * least(1.0e0, exp(-({x})*({x})) * abs({x}) *
  list_sum(list_transform(range(0, 120), lambda n: pow(({x})*({x}), n) / gamma(n + 1.5e0)))) END)"""


def erf_sql(x: str) -> str:
    return ERF.replace("{x}", x)


def ecdf_sql(source: str, keys: list[str], name: str = "ecdf", value: str = "value", is_first: str = "is_ref") -> str:
    """Cumulative counts of both sides over distinct values."""
    k = "".join(f"{c}, " for c in keys)
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""{name} AS (
  SELECT {k}v, a, b, sum(a) OVER (w ROWS UNBOUNDED PRECEDING) AS ca, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS cb,
         sum(a) OVER ({by}) AS ta, sum(b) OVER ({by}) AS tb, lead(v) OVER w AS nv
  FROM (SELECT {k}{value} AS v, count(*) FILTER (WHERE {is_first}) AS a, count(*) FILTER (WHERE NOT {is_first}) AS b
        FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) g
  WINDOW w AS ({by} ORDER BY v)
)"""


def advice_sql(detected: str, statistic: str, feature: str = "feature_name") -> str:
    return f"""CASE WHEN NOT ({detected}) THEN 'No action needed. Distribution remains stable.'
  WHEN {statistic} > 0.5 THEN 'CRITICAL: Severe drift in ' || {feature} || '. Immediate retraining and pipeline check required.'
  ELSE 'WARNING: Drift detected in ' || {feature} || '. Scheduling auto-retraining pipeline.' END"""


def hash_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"


def bucket_sql(key: str, salt: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT) % 10000)"
