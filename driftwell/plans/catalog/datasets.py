"""Sources, sinks, data quality, transforms and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell import config
from driftwell.functions.text import strip_breaks
from driftwell.operators import quality as Q
from driftwell.operators import splits as S
from driftwell.operators import textfeatures as X
from driftwell.operators import transforms as T
from driftwell.plans import exports, views
from driftwell.plans.catalog.base import LOGS, hash_sql, query
from driftwell.session import scratch_path
from driftwell.sources import tables as I

table = I.table


@query("scan_tabular", """SELECT p_partkey, CAST(p_size AS FLOAT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice, p_brand AS target FROM part""")
def scan_tabular(spark, d):
    source = I.read_any(spark, f"{d}/part.parquet")
    return I.scan_tabular(source, "p_brand", ["p_size", "p_retailprice"], key="p_partkey")


@query("scan_text", """SELECT doc_id, coalesce(text, '') AS text, quality AS label FROM documents JOIN labels USING (doc_id)""")
def scan_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id"
    )
    return I.scan_text(docs, "text", "quality")


@query("scan_image_arrays", """WITH m AS (SELECT max(list_max(embedding)) * 300 AS peak FROM embeddings)
SELECT vec_id, CAST(8 AS INTEGER) AS side, label, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 300 / (CASE WHEN peak > 1 THEN 255 ELSE 1 END))), 4) + 0 AS total
FROM embeddings, m""", 4)
def scan_image_arrays(spark, d):
    raw = table(spark, d, "embeddings").withColumn(
        "embedding", F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 300)
    )
    arrays = I.scan_image_arrays(raw, "embedding", "label", "vec_id")
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return arrays.select("vec_id", "side", "label", total.alias("total"))


@query("dataset_info", """SELECT count(*) AS num_samples, CAST(NULL AS DOUBLE) AS avg_text_length, CAST(3 AS BIGINT) AS num_features,
'l_quantity,l_discount,l_tax' AS feature_names, (SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem) AS class_labels FROM lineitem""")
def dataset_info(spark, d):
    return I.dataset_info(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query("dataset_info_text", """SELECT count(*) AS num_samples, round(avg(length(text)), 6) AS avg_text_length, CAST(0 AS BIGINT) AS num_features,
'' AS feature_names, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS class_labels FROM documents""")
def dataset_info_text(spark, d):
    return I.dataset_info(table(spark, d, "documents"), "lang", [], "text")


@query("sample_n", f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql("o_orderkey", 42)}, o_orderkey LIMIT 1000""")
def sample_n(spark, d):
    return S.sample_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query("scan_database", """SELECT r_name, count(*) AS nations, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance
FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name""", 2)
def scan_database(spark, d):
    sql = """SELECT r_name, count(*) AS nations, count(c_custkey) AS customers, sum(c_acctbal) AS balance
             FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey
             GROUP BY r_name"""
    return I.scan_query(spark, sql, {t: table(spark, d, t) for t in ("region", "nation", "customer")})


@query("sink_dataset", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag""", 2)
def sink_dataset(spark, d):
    path = I.write_dataset(table(spark, d, "lineitem"), scratch_path(spark, "dataset") + ".parquet")
    return I.read_any(spark, path).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


EXPORT = f"""WITH {LOGS}, fresh AS (SELECT f0, f1, f2, ground_truth AS target FROM logs WHERE ground_truth IS NOT NULL),
base AS (SELECT value AS f0, CAST(event_id AS DOUBLE) AS f1, CAST(user_id AS DOUBLE) AS f2, CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0 END AS target FROM events)"""


def _baseline(spark, d):
    return views.events(spark, d).select(
        F.col("value").alias("f0"), F.col("event_id").cast("double").alias("f1"),
        F.col("user_id").cast("double").alias("f2"), (F.col("event_type") == "error").cast("double").alias("target"),
    )


@query("export_training", f"""{EXPORT} SELECT *, 'fresh' AS origin FROM fresh UNION ALL SELECT *, 'baseline' FROM base""")
def export_training(spark, d):
    return exports.export_training(views.prediction_logs(spark, d), 3, _baseline(spark, d))


@query("sink_timestamped_export", f"""{EXPORT} SELECT target, count(*) AS n, round(sum(f0), 2) AS f0, round(sum(f1), 2) AS f1 FROM fresh GROUP BY target""", 2)
def sink_timestamped_export(spark, d):
    rows = exports.export_training(views.prediction_logs(spark, d), 3, None).drop("origin")
    path = I.export_path(scratch_path(spark, "export"), "credit-risk", 1706745600)
    I.write_dataset(rows, path)
    back = I.read_any(spark, path, "feature_0 double, feature_1 double, feature_2 double, target double")
    return back.groupBy("target").agg(
        F.count("*").alias("n"), F.sum("feature_0").alias("f0"), F.sum("feature_1").alias("f1")
    )


def _audit_entries(spark, d):
    return views.events(spark, d).select(
        F.col("event_type").alias("action"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user"),
        F.lit("10.0.0.1").alias("ip_address"), F.lit("/predict").alias("resource"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        (F.col("event_type") != "error").alias("success"), F.col("props").alias("details"),
        F.format_string("%012d", F.col("event_id")).alias("correlation_id"),
    )


def _audit(spark, d):
    """Audit lines written as JSON, with a malformed line for every view."""
    path = scratch_path(spark, "audit")
    I.append_audit(_audit_entries(spark, d), path)
    views.events(spark, d).filter("event_type = 'view'").select(
        F.concat(F.lit('{"action": "view", broken '), F.col("event_id").cast("string"))
    ).write.mode("append").text(path)
    return I.read_audit(spark, path)


@query("source_jsonl_audit", """SELECT event_type AS action, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS succeeded FROM events GROUP BY event_type""")
def source_jsonl_audit(spark, d):
    return _audit(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.count_if("success").alias("succeeded"))


@query("sink_audit", """SELECT CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'OK' END AS outcome, 'user-' || user_id AS user, count(*) AS entries FROM events GROUP BY ALL""")
def sink_audit(spark, d):
    path = scratch_path(spark, "audit_sink")
    I.append_audit(_audit_entries(spark, d), path)
    outcome = F.when(F.col("success"), F.lit("OK")).otherwise(F.lit("FAIL"))
    return I.read_audit(spark, path).groupBy(outcome.alias("outcome"), "user").agg(F.count("*").alias("entries"))


@query("audit_query", """SELECT printf('%012d', event_id) AS correlation_id, 'user-' || user_id AS user, props AS details
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def audit_query(spark, d):
    return I.audit_query(_audit(spark, d), action="error").select("correlation_id", "user", "details")


@query("data_change_detect", """WITH old AS (SELECT year(o_orderdate) AS part, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND year(o_orderdate) % 2 = 0) AS touched FROM orders GROUP BY 1)
SELECT CAST(part AS INTEGER) AS part, CASE WHEN part <= (SELECT min(part) FROM old) THEN 'removed' ELSE 'changed' END AS change, n AS old_rows,
CASE WHEN part <= (SELECT min(part) FROM old) THEN 0 ELSE n END AS new_rows FROM old WHERE part <= (SELECT min(part) FROM old) OR touched > 0
UNION ALL SELECT CAST((SELECT max(part) FROM old) + 10 AS INTEGER), 'added', 0, (SELECT n FROM old WHERE part = (SELECT max(part) FROM old))""")
def data_change_detect(spark, d):
    old = table(spark, d, "orders")
    year = F.year("o_orderdate")
    bounds = old.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi"))).scalar()
    marked = old.withColumn("_b", bounds)
    touched = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW") & (year % 2 == 0)
    kept = marked.filter(year > F.col("_b")["lo"]).withColumn(
        "o_totalprice", F.when(touched, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    ).drop("_b")
    added = marked.filter(year == F.col("_b")["hi"]).drop("_b").withColumn(
        "o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS")
    )
    new = kept.unionByName(added)
    return I.data_changes(I.manifest(old, year), I.manifest(new, year))


# Data quality -------------------------------------------------------------

DIRTY = """dirty AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS income,
 CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) END AS age,
 CASE WHEN event_id % 3 = 0 THEN event_type END AS category, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS target FROM events)"""


def _profile_sql(name: str, dtype: str, number: bool) -> str:
    stats = (
        f"round(avg({name}), 4) AS mean, round(stddev_samp({name}), 4) AS std, CAST(min({name}) AS DOUBLE) AS min_val, CAST(max({name}) AS DOUBLE) AS max_val"
        if number else "NULL AS mean, NULL AS std, NULL AS min_val, NULL AS max_val"
    )
    return f"""SELECT '{name}' AS column, '{dtype}' AS dtype, count({name}) AS non_null_count, count(*) - count({name}) AS null_count,
 round((count(*) - count({name})) * 100.0e0 / count(*), 2) AS null_percent, count(DISTINCT {name}) AS unique_count, {stats} FROM dirty"""


@query("column_profile", f"WITH {DIRTY} " + " UNION ALL ".join([
    _profile_sql("event_id", "bigint", True), _profile_sql("income", "double", True), _profile_sql("age", "double", True),
    _profile_sql("category", "string", False), _profile_sql("target", "int", True)]))
def column_profile(spark, d):
    return Q.column_profile(views.dirty_numbers(spark, d))


@query("overall_null_pct", f"""WITH {DIRTY}, n AS (SELECT count(*) AS n, sum((income IS NULL)::INT + (age IS NULL)::INT + (category IS NULL)::INT) AS nulls FROM dirty)
SELECT n AS row_count, CAST(5 AS BIGINT) AS column_count, round(nulls * 100.0e0 / (n * 5), 2) AS null_percent, n >= 10 AND nulls * 100.0e0 / (n * 5) <= 50 AS validation_passed FROM n""")
def overall_null_pct(spark, d):
    return Q.overall_null_gate(views.dirty_numbers(spark, d))


NULL_ISSUES = " UNION ALL ".join(
    f"SELECT '{c}' AS c, avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0 END) * 100 AS p FROM dirty" for c in ("event_id", "income", "age", "category", "target")
)
NULLS_SQL = f"""nullp AS ({NULL_ISSUES}), nulls AS (SELECT c AS column, CASE WHEN p > 30 THEN 'error' ELSE 'warning' END AS severity,
CASE WHEN p > 30 THEN 'high_null_rate' ELSE 'has_nulls' END AS issue_type,
c || ' has ' || printf('%.1f%%', p) || ' null values' || CASE WHEN p > 30 THEN ' (threshold: 30.0%)' ELSE '' END AS message, round(p, 2) AS value FROM nullp WHERE p > 0)"""


@query("dq_empty", f"""WITH {DIRTY} SELECT '*' AS column, 'error' AS severity, 'empty_dataset' AS issue_type, 'Dataset has 0 rows' AS message, 0.0e0 AS value
WHERE (SELECT count(*) FROM dirty WHERE income < 0) = 0""")
def dq_empty(spark, d):
    return Q.check_empty(views.dirty_numbers(spark, d).filter("income < 0")).drop("check_order")


@query("dq_nulls", f"WITH {DIRTY}, {NULLS_SQL} SELECT * FROM nulls")
def dq_nulls(spark, d):
    return Q.check_nulls(views.dirty_numbers(spark, d)).drop("check_order")


@query("dq_duplicates", """WITH g AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS dup FROM g)
SELECT '*' AS column, 'warning' AS severity, 'high_duplicates' AS issue_type, 'Dataset has ' || dup || ' duplicate rows (' || printf('%.1f%%', dup * 100.0e0 / total) || ')' AS message,
round(dup * 100.0e0 / total, 2) AS value FROM s WHERE dup * 100.0e0 / total > 10""")
def dq_duplicates(spark, d):
    return Q.check_duplicates(table(spark, d, "lineitem").select("l_suppkey", "l_quantity")).drop("check_order")


def _outlier_sql(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS c, (SELECT count(*) FROM {source}, b WHERE {name} < lo OR {name} > hi) AS n FROM
 (SELECT 1) WHERE (SELECT q3 - q1 FROM b) <> 0""".replace(
        "FROM\n (SELECT 1)", "FROM (SELECT 1)"
    ).replace(", b WHERE", f", (SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.75) AS q3, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM {source}) b WHERE").replace(
        "(SELECT q3 - q1 FROM b)", f"(SELECT quantile_cont({name}, 0.75) - quantile_cont({name}, 0.25) FROM {source})"
    )


OUTLIERS = " UNION ALL ".join(_outlier_sql(c, "dirty") for c in ("event_id", "income", "age", "target"))
OUTLIER_SQL = f"""outc AS ({OUTLIERS}), outl AS (SELECT c AS column, 'info' AS severity, 'outliers_detected' AS issue_type,
c || ' has ' || n || ' outlier(s) beyond 3.0×IQR' AS message, CAST(n AS DOUBLE) AS value FROM outc WHERE n > 0)"""


@query("dq_outliers", f"WITH {DIRTY}, {OUTLIER_SQL} SELECT * FROM outl")
def dq_outliers(spark, d):
    return Q.check_outliers(views.dirty_numbers(spark, d)).drop("check_order")


RANGES = {"income": (1.0, 200.0), "age": (0.0, 90.0), "missing": (0.0, 1.0)}
RANGE_SQL = """rangec AS (SELECT 'income' AS c, count(*) FILTER (WHERE income < 1 OR income > 200) AS n, '[1.0, 200.0]' AS span FROM dirty
 UNION ALL SELECT 'age', count(*) FILTER (WHERE age < 0 OR age > 90), '[0.0, 90.0]' FROM dirty),
ranges_ AS (SELECT c AS column, 'warning' AS severity, 'out_of_range' AS issue_type, c || ': ' || n || ' values outside ' || span AS message, CAST(n AS DOUBLE) AS value FROM rangec WHERE n > 0)"""


@query("dq_ranges", f"WITH {DIRTY}, {RANGE_SQL} SELECT * FROM ranges_")
def dq_ranges(spark, d):
    return Q.check_ranges(views.dirty_numbers(spark, d), RANGES).drop("check_order")


def _target_sql(t: str) -> str:
    return f"""tgt AS (SELECT count(*) - count({t}) AS nulls, count(DISTINCT {t}) AS kinds FROM dirty),
tissue AS (SELECT '{t}' AS column, 'error' AS severity, 'target_has_nulls' AS issue_type, 'Target column has null values' AS message, CAST(nulls AS DOUBLE) AS value FROM tgt WHERE nulls > 0
 UNION ALL SELECT '{t}', 'error', 'constant_target', 'Target has only 1 unique value', CAST(kinds AS DOUBLE) FROM tgt WHERE kinds = 1)"""


@query("dq_target", f"WITH {DIRTY}, {_target_sql('category')} SELECT * FROM tissue")
def dq_target(spark, d):
    return Q.check_target(views.dirty_numbers(spark, d), "category").drop("check_order")


REPORT = f"WITH {DIRTY}, {NULLS_SQL}, {OUTLIER_SQL}, {RANGE_SQL}, {_target_sql('target')}"


@query("dq_report", f"""{REPORT} SELECT *, CAST(1 AS INTEGER) AS check_order FROM nulls UNION ALL SELECT *, 3 FROM outl UNION ALL SELECT *, 4 FROM ranges_ UNION ALL SELECT *, 5 FROM tissue""")
def dq_report(spark, d):
    return Q.quality_issues(views.dirty_numbers(spark, d), "target", RANGES)


@query("dq_summary", f"""{REPORT}, a AS (SELECT severity FROM nulls UNION ALL SELECT severity FROM outl UNION ALL SELECT severity FROM ranges_ UNION ALL SELECT severity FROM tissue)
SELECT (SELECT count(*) FROM dirty) AS total_rows, CAST(5 AS BIGINT) AS total_columns, count(*) AS issue_count, count(*) FILTER (WHERE severity = 'error') AS error_count,
count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM a""")
def dq_summary(spark, d):
    rows = views.dirty_numbers(spark, d)
    return Q.quality_summary(rows, Q.quality_issues(rows, "target", RANGES))


ALLNULL = """t AS (SELECT CASE WHEN event_id % 9 <> 0 THEN income END AS income, CASE WHEN event_id % 9 <> 0 THEN age END AS age FROM dirty),
kept AS (SELECT * FROM t WHERE income IS NOT NULL OR age IS NOT NULL)"""


@query("clean_basic", f"""WITH {DIRTY}, {ALLNULL} SELECT round(coalesce(income, (SELECT median(income) FROM kept)), 6) AS income,
round(coalesce(age, (SELECT median(age) FROM kept)), 6) AS age FROM kept""")
def clean_basic(spark, d):
    rows = views.dirty_numbers(spark, d)
    hole = F.col("event_id") % 9 != 0
    return Q.clean_basic(rows.select(F.when(hole, F.col("income")).alias("income"), F.when(hole, F.col("age")).alias("age")))


@query("ingest_run", f"""WITH {DIRTY} SELECT true AS success, (SELECT count(*) FROM dirty) AS rows_processed, count(*) AS rows_stored,
round(sum(coalesce(income, (SELECT median(income) FROM dirty))), 2) AS income, round(sum(coalesce(age, (SELECT median(age) FROM dirty))), 2) AS age FROM dirty""", 2)
def ingest_run(spark, d):
    source = views.dirty_numbers(spark, d).drop("category")
    path = scratch_path(spark, "ingested") + ".parquet"
    result = exports.ingest(source, "target", path=path)
    stored = I.read_any(spark, path)
    return stored.agg(F.sum("income").alias("income"), F.sum("age").alias("age")).select(
        F.lit(result.success).alias("success"), F.lit(result.rows_processed).cast("bigint").alias("rows_processed"),
        F.lit(result.rows_stored).cast("bigint").alias("rows_stored"), "income", "age",
    )


# Transforms ---------------------------------------------------------------

@query("standard_scale", f"""WITH {DIRTY}, s AS (SELECT avg(income) AS m1, stddev_samp(income) AS s1, avg(age) AS m2, stddev_samp(age) AS s2 FROM dirty)
SELECT event_id, round((income - m1) / s1, 6) + 0 AS income, round((age - m2) / s2, 6) + 0 AS age FROM dirty, s""")
def standard_scale(spark, d):
    rows = views.dirty_numbers(spark, d).select("event_id", "income", "age")
    return T.StandardScaler(["income", "age"]).fit_transform(rows)


@query("minmax_scale", f"""WITH {DIRTY}, s AS (SELECT min(income) AS l1, max(income) AS h1, min(age) AS l2, max(age) AS h2 FROM dirty)
SELECT event_id, round((income - l1) / (h1 - l1), 6) AS income, round((age - l2) / (h2 - l2), 6) AS age, 0.0e0 AS flat FROM dirty, s""")
def minmax_scale(spark, d):
    rows = views.dirty_numbers(spark, d).select("event_id", "income", "age")
    flat = rows.withColumn("flat", F.when(F.col("income").isNotNull(), F.lit(3.0)))
    return T.MinMaxScaler(["income", "age", "flat"]).fit_transform(flat)


@query("log_transform", f"""WITH {DIRTY} SELECT event_id, CASE WHEN income IS NOT NULL THEN round(ln(1 + greatest(income - 10, 0)), 6) END AS income FROM dirty""")
def log_transform(spark, d):
    rows = views.dirty_numbers(spark, d).select("event_id", (F.col("income") - 10).alias("income"))
    return T.LogTransform(["income"]).fit_transform(rows)


@query("impute", f"""WITH {DIRTY} SELECT event_id, round(coalesce(income, (SELECT median(income) FROM dirty)), 6) AS income_median,
round(coalesce(income, (SELECT avg(income) FROM dirty)), 6) AS income_mean, coalesce(income, -1) AS income_constant FROM dirty""")
def impute(spark, d):
    rows = views.dirty_numbers(spark, d).select(
        "event_id", *[F.col("income").alias(f"income_{k}") for k in ("median", "mean", "constant")]
    )
    for strategy in ("median", "mean", "constant"):
        rows = T.Imputer(strategy, -1.0, [f"income_{strategy}"]).fit_transform(rows)
    return rows


HOT = ", ".join(f"CASE WHEN category = '{c}' THEN 1 ELSE 0 END AS category_{c}" for c in ("error", "purchase", "signup", "view"))


@query("one_hot", f"WITH {DIRTY} SELECT event_id, {HOT} FROM dirty")
def one_hot(spark, d):
    return T.OneHotEncoder(["category"]).fit_transform(views.dirty_numbers(spark, d).select("event_id", "category"))


ORD = "CASE category WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END"


@query("ordinal_encode", f"WITH {DIRTY} SELECT event_id, CAST({ORD} AS INTEGER) AS category FROM dirty")
def ordinal_encode(spark, d):
    return T.OrdinalEncoder(["category"]).fit_transform(views.dirty_numbers(spark, d).select("event_id", "category"))


@query("ordinal_encode_many", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS INTEGER) AS code FROM lineitem""")
def ordinal_encode_many(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("code"))
    return T.OrdinalEncoder(["code"], inline=100).fit_transform(rows)


@query("one_hot_sparse", """WITH c AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) AS r FROM orders), n AS (SELECT CAST(count(DISTINCT o_custkey) - 1 AS INTEGER) AS size FROM orders)
SELECT o_orderkey, size, CASE WHEN r > 1 THEN CAST(r - 2 AS INTEGER) END AS place, CASE WHEN r > 1 THEN 1.0e0 END AS value FROM c, n""")
def one_hot_sparse(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"))
    vector = T.OneHotEncoder(["c"], wide=10).fit_transform(rows)
    return vector.select("o_orderkey", "c_onehot.size", F.try_element_at("c_onehot.indices", F.lit(1)).alias("place"),
                         F.try_element_at("c_onehot.values", F.lit(1)).alias("value"))


@query("feature_transform_chain", f"""WITH {DIRTY}, i AS (SELECT event_id, coalesce(income, (SELECT median(income) FROM dirty)) AS income,
coalesce(age, (SELECT median(age) FROM dirty)) AS age, category FROM dirty), s AS (SELECT avg(income) AS m1, stddev_samp(income) AS s1, avg(age) AS m2, stddev_samp(age) AS s2 FROM i)
SELECT event_id, round((income - m1) / s1, 6) + 0 AS income, round((age - m2) / s2, 6) + 0 AS age, {HOT} FROM i, s""")
def feature_transform_chain(spark, d):
    rows = views.dirty_numbers(spark, d).select("event_id", "income", "age", "category")
    chain = T.TransformChain([T.Imputer("median", columns=["income", "age"])])
    chain.add(T.StandardScaler(["income", "age"])).add(T.OneHotEncoder(["category"]))
    return chain.fit_transform(rows)


@query("label_encode", """SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_index FROM documents""")
def label_encode(spark, d):
    return T.label_encode(table(spark, d, "documents").select("doc_id", "lang"), "lang")


@query("engineer_features", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS d, l_extendedprice / 1000 AS c, l_discount * 10 AS i, l_tax * 100 AS a, CAST(l_linenumber AS DOUBLE) AS e,
 l_suppkey % 5 AS emp, l_suppkey % 4 AS chk, l_suppkey % 3 AS sav FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(c / (d + 1e-8), 6) AS credit_per_month, round(a / (c + 1e-8), 6) AS age_credit_ratio, round(i / (c + 1e-8), 6) AS installment_credit_ratio,
round(a * (emp + 1), 6) AS age_employment_score, round(c * i / (d + 1e-8), 6) AS credit_risk_density, round(d * i, 6) AS duration_installment,
chk * sav AS checking_savings_interact, round(a * chk, 6) AS age_checking_interact, round(c * e, 6) AS credit_existing_interact, round(ln(1 + abs(c)), 6) AS log_credit_amount FROM b""")
def engineer_features(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("d"), (F.col("l_extendedprice") / 1000).alias("c"),
        (F.col("l_discount") * 10).alias("i"), (F.col("l_tax") * 100).alias("a"),
        F.col("l_linenumber").cast("double").alias("e"), (F.col("l_suppkey") % 5).alias("emp"),
        (F.col("l_suppkey") % 4).alias("chk"), (F.col("l_suppkey") % 3).alias("sav"),
    )
    out = T.engineer_credit_features(li, "d", "c", "i", "a", "e", "emp", "chk", "sav")
    return out.drop("d", "c", "i", "a", "e", "emp", "chk", "sav")


@query("map_credit_columns", """SELECT CAST(c_custkey AS BIGINT) AS customer, c_acctbal AS credit_amount, CAST(c_nationkey AS DOUBLE) AS duration,
CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS target FROM customer""")
def map_credit_columns(spark, d):
    return T.map_columns(
        table(spark, d, "customer"),
        {"customer": ("c_custkey", "bigint"), "credit_amount": ("c_acctbal", "double"), "duration": ("c_nationkey", "double")},
        F.col("c_mktsegment") == "BUILDING",
    )


@query("html_strip", """SELECT page_id, regexp_replace(replace(html, '<p>', '<br />'), '<br ?/>', ' ', 'g') AS html FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select(
        "page_id", strip_breaks(F.replace("html", F.lit("<p>"), F.lit("<br />"))).alias("html")
    )


TFIDF = """n AS (SELECT count(*) AS n FROM documents),
words AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL
 SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95e0 * (SELECT n FROM n)
 ORDER BY cf DESC, term LIMIT 5000)"""


@query("tfidf", f"""WITH {TFIDF}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def tfidf(spark, d):
    docs = X.terms(table(spark, d, "documents"), "doc_id", "text")
    return X.weights(docs, X.vocabulary(docs), "doc_id").select("doc_id", "term", "weight")


@query("tfidf_vocabulary", f"""WITH {TFIDF} SELECT term, df, round(ln((1.0e0 + n) / (1 + df)) + 1, 6) AS idf,
CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM vocab, n""")
def tfidf_vocabulary(spark, d):
    return X.vocabulary(X.terms(table(spark, d, "documents"), "doc_id", "text"))


# Splits -------------------------------------------------------------------

@query("train_test_split", f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql("o_orderkey", 42)}, o_orderkey) AS r,
count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority, r <= round(n * 0.2e0) AS is_test FROM r""")
def train_test_split(spark, d):
    return S.train_test_split(
        table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority"
    )


@query("train_test_split_plain", f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY {hash_sql("p_partkey", 42)}, p_partkey) AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, r <= round(n * 0.2e0) AS is_test FROM r""")
def train_test_split_plain(spark, d):
    return S.train_test_split(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", max_classes=config.MAX_CLASSES).drop("p_retailprice")


@query("kfold_assign", " UNION ALL ".join(f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql("o_orderkey", 42 + r)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold,
CAST({r} AS INTEGER) AS repeat FROM orders""" for r in range(3)))
def kfold_assign(spark, d):
    return S.repeated_kfold(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
