"""Feature store, registry, run and job history, scoring, routing, explanation and training."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from driftwell.operators import history as H
from driftwell.operators import scoring as C
from driftwell.operators import store as S
from driftwell.operators import training as T
from driftwell.plans import views
from driftwell.plans.catalog.base import LOGS, bucket_sql, hash_sql, query
from driftwell.plans.catalog.drifts import ks_sql
from driftwell.plans.catalog.logs import registry_of_two
from driftwell.session import scratch_path
from driftwell.sources.tables import table

NAMES = ["purchase", "view", "click"]


def _store(spark, d):
    return views.feature_values(spark, d)


# Latest value per (user, type); `store` mirrors the Spark view.
STORE = """store AS (SELECT user_id AS entity_id, event_type AS feature, value, ts AS event_ts,
 CASE WHEN event_type = 'click' THEN ts + INTERVAL 7 DAY END AS expires_at FROM events)"""
LATEST = "latest AS (SELECT entity_id, feature, arg_max(value, event_ts) AS value FROM store GROUP BY ALL)"
VECTORS = f"""{STORE}, {LATEST}, vec AS (SELECT entity_id, coalesce(max(value) FILTER (WHERE feature = 'purchase'), 0) AS purchase,
 coalesce(max(value) FILTER (WHERE feature = 'view'), 0) AS view_, coalesce(max(value) FILTER (WHERE feature = 'click'), 0) AS click
 FROM latest WHERE feature IN ('purchase', 'view', 'click') GROUP BY entity_id)"""


def _flat(df, names, column="features"):
    return [F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)]


@query("online_features", f"""WITH {VECTORS} SELECT c_custkey AS entity_id, purchase, view_, click FROM customer LEFT JOIN vec ON c_custkey = entity_id""")
def online_features(spark, d):
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return S.online_features(requests, _store(spark, d), NAMES).select(
        "entity_id", *_flat(None, ["purchase", "view_", "click"])
    )


@query("features_batch", f"""WITH {VECTORS}, r AS (SELECT DISTINCT o_custkey AS entity_id FROM orders)
SELECT r.entity_id, vec.entity_id IS NOT NULL AS known, click, purchase FROM r LEFT JOIN vec ON r.entity_id = vec.entity_id""")
def features_batch(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id")).distinct()
    got = S.online_features(requests, _store(spark, d), ["click", "purchase", "view"])
    return got.select("entity_id", F.col("features").isNotNull().alias("known"), *_flat(None, ["click", "purchase"]))


@query("feature_upsert", f"""WITH {STORE}, all_ AS (SELECT entity_id, feature, value, event_ts FROM store
 UNION ALL SELECT c_custkey, 'view', c_acctbal, TIMESTAMP '2024-03-01' FROM customer)
SELECT entity_id, feature, arg_max(value, event_ts) AS value FROM all_ GROUP BY ALL""")
def feature_upsert(spark, d):
    changes = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.lit("view").alias("feature"), F.col("c_acctbal").alias("value"),
        F.lit("2024-03-01").cast("timestamp_ntz").alias("event_ts"),
    )
    return S.latest_values(S.upsert(_store(spark, d), changes)).drop("event_ts")


@query("feature_upsert_batch", """SELECT count(DISTINCT user_id) AS entities, count(DISTINCT (user_id, event_type)) AS fields, count(*) AS rows FROM events""")
def feature_upsert_batch(spark, d):
    return S.batch_counts(_store(spark, d))


@query("feature_ttl", f"""WITH {STORE}, e AS (SELECT entity_id, arg_max(expires_at, event_ts) FILTER (WHERE expires_at IS NOT NULL) AS x FROM store GROUP BY entity_id),
s AS (SELECT c_custkey, e.entity_id, x, epoch_us(x) - epoch_us(TIMESTAMP '2024-01-31 12:00:00') AS left_us FROM customer LEFT JOIN e ON c_custkey = e.entity_id)
SELECT c_custkey AS entity_id, CAST(CASE WHEN entity_id IS NULL THEN -2 WHEN x IS NULL THEN -1 WHEN left_us <= 0 THEN -2 ELSE floor(left_us / 1e6) END AS BIGINT) AS ttl FROM s""")
def feature_ttl(spark, d):
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return S.ttl_seconds(_store(spark, d), entities, F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query("feature_expired", f"""WITH {STORE} SELECT entity_id, feature, arg_max(value, event_ts) AS value FROM store
WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31' GROUP BY ALL""")
def feature_expired(spark, d):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return S.latest_values(_store(spark, d), now).drop("event_ts")


@query("feature_delete", f"""WITH {STORE} SELECT entity_id, count(*) AS rows FROM store WHERE entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY entity_id""")
def feature_delete(spark, d):
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"))
    return S.delete_entities(_store(spark, d), gone).groupBy("entity_id").agg(F.count("*").alias("rows"))


@query("feature_delete_count", f"""SELECT count(DISTINCT user_id) AS deleted FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def feature_delete_count(spark, d):
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"))
    return S.deleted_count(_store(spark, d), gone)


@query("list_entities", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%' ORDER BY 1 LIMIT 100""")
def list_entities(spark, d):
    return S.list_entities(_store(spark, d), "1", 100)


@query("feature_entity_counts", """SELECT user_id AS entity_id, count(DISTINCT event_type) AS feature_count,
string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS feature_names FROM events GROUP BY user_id""")
def feature_entity_counts(spark, d):
    return S.entity_feature_counts(_store(spark, d))


def _labels(spark, d):
    e = views.events(spark, d).filter("event_type = 'purchase'")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    return e.select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("label_id"), "ts", (k % 2).alias("label")
    )


ASOF_NAMES = ["view", "click", "error", "signup"]
ASOF = f"""WITH {LOGS}, lab AS (SELECT entity_id, id AS label_id, created_at AS ts, k % 2 AS label FROM logs WHERE event_type = 'purchase')""" + "".join(
    f", v_{n} AS (SELECT l.label_id, s.value, s.ts AS seen FROM lab l ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = '{n}') s ON l.entity_id = s.user_id AND l.ts >= s.ts)"
    for n in ASOF_NAMES
)
ASOF_JOINS = " ".join(f"JOIN v_{n} USING (label_id)" for n in ASOF_NAMES)


@query("historical_features", f"""{ASOF} SELECT entity_id, label_id, lab.ts AS ts, {', '.join(f"v_{n}.value AS {n}" for n in ASOF_NAMES)} FROM lab {ASOF_JOINS}""")
def historical_features(spark, d):
    return S.historical_features(_labels(spark, d), _store(spark, d), ASOF_NAMES)


@query("historical_features_max_age", f"""{ASOF} SELECT entity_id, label_id, lab.ts AS ts,
{', '.join(f"CASE WHEN epoch_us(lab.ts) - epoch_us(v_{n}.seen) <= 86400000000 THEN v_{n}.value END AS {n}" for n in ASOF_NAMES)} FROM lab {ASOF_JOINS}""")
def historical_features_max_age(spark, d):
    return S.historical_features(_labels(spark, d), _store(spark, d), ASOF_NAMES, max_age_seconds=86400)


@query("training_dataset", f"""{ASOF} SELECT entity_id, label_id, CAST(label AS INTEGER) AS label, {', '.join(f"coalesce(v_{n}.value, 0) AS {n}" for n in ASOF_NAMES)} FROM lab {ASOF_JOINS}""")
def training_dataset(spark, d):
    return S.training_dataset(
        _labels(spark, d), _store(spark, d), ASOF_NAMES, scratch_path(spark, "training")
    ).drop("ts")


@query("enrich_requests", f"""WITH {LOGS}, {VECTORS} SELECT id, CASE WHEN id % 2 = 0 THEN f0 ELSE purchase END AS a,
CASE WHEN id % 2 = 0 THEN f1 ELSE view_ END AS b, CASE WHEN id % 2 = 0 THEN f2 ELSE click END AS c FROM logs LEFT JOIN vec USING (entity_id)""")
def enrich_requests(spark, d):
    requests = views.prediction_logs(spark, d).select(
        "id", "entity_id", F.when(F.col("id") % 2 == 0, F.col("features")).alias("features")
    )
    return S.enrich_requests(requests, _store(spark, d), NAMES).select("id", *_flat(None, ["a", "b", "c"]))


# Registry -----------------------------------------------------------------

REGISTRY = """ev AS (SELECT o_orderkey AS seq, o_orderdate AS moment, 'model-' || (o_custkey % 200) AS model_id, '1.' || (o_orderkey % 7) || '.0' AS version,
 CASE WHEN o_orderkey % 10 < 5 THEN 'save' WHEN o_orderkey % 10 < 9 THEN 'stage' ELSE 'rollback' END AS action,
 CASE WHEN o_orderkey % 10 < 4 THEN 'challenger' WHEN o_orderkey % 10 < 7 THEN 'champion' WHEN o_orderkey % 10 = 7 THEN 'archived' WHEN o_orderkey % 10 = 8 THEN 'staging' END AS stage0,
 o_totalprice / 1e6 AS accuracy FROM orders),
st AS (SELECT *, CASE WHEN action = 'rollback' THEN 'archived' ELSE stage0 END AS stage, row_number() OVER (ORDER BY moment, seq) AS n FROM ev),
-- stage events of a version before its first save touch nothing
firsts AS (SELECT model_id, version, min(n) AS born FROM st WHERE action = 'save' GROUP BY ALL),
own AS (SELECT s.model_id, s.version, arg_max(stage, n) AS stage, max(n) AS n, max(moment) AS moment, arg_max('models/' || seq, n) FILTER (WHERE action = 'save') AS uri,
 arg_max(accuracy, n) FILTER (WHERE action = 'save') AS accuracy FROM st s JOIN firsts f ON s.model_id = f.model_id AND s.version = f.version GROUP BY ALL),
promo AS (SELECT model_id, version, n FROM st WHERE action = 'stage' AND stage = 'champion'),
state AS (SELECT o.model_id, o.version, uri, 'onnx' AS framework, accuracy, moment AS changed_at,
 CASE WHEN stage = 'champion' AND EXISTS (SELECT 1 FROM promo p WHERE p.model_id = o.model_id AND p.version <> o.version AND p.n > o.n) THEN 'retired' ELSE stage END AS stage FROM own o)"""


def _state(spark, d):
    return H.registry_state(views.registry_events(spark, d))


def _plain_state(df):
    return df.withColumn("accuracy", F.col("metrics")["accuracy"]).drop("metrics")


@query("model_registry_state", f"""WITH {REGISTRY} SELECT model_id, version, uri, framework, stage, changed_at, stage NOT IN ('archived', 'retired') AS is_active, round(accuracy, 6) AS accuracy FROM state""")
def model_registry_state(spark, d):
    return _plain_state(_state(spark, d))


@query("model_champion", f"WITH {REGISTRY} SELECT model_id, version, uri FROM state WHERE stage = 'champion'")
def model_champion(spark, d):
    return H.champion(_state(spark, d)).select("model_id", "version", "uri")


@query("model_active", f"WITH {REGISTRY} SELECT model_id, version, stage FROM state WHERE stage NOT IN ('archived', 'retired') AND model_id = 'model-7'")
def model_active(spark, d):
    return H.active(_state(spark, d), "model-7").select("model_id", "version", "stage")


@query("model_by_id", f"WITH {REGISTRY} SELECT model_id, version, stage, uri FROM state WHERE model_id = 'model-7' AND version = '1.3.0'")
def model_by_id(spark, d):
    return H.by_id(_state(spark, d), "model-7", "1.3.0").select("model_id", "version", "stage", "uri")


@query("model_list", f"WITH {REGISTRY} SELECT model_id, version, stage FROM state WHERE stage NOT IN ('archived', 'retired') ORDER BY model_id, version")
def model_list(spark, d):
    return H.listed(_state(spark, d)).select("model_id", "version", "stage")


# Runs and jobs ------------------------------------------------------------

RUNS = """runs AS (SELECT 'run-' || o_orderkey AS run_id, o_orderpriority AS experiment_name, 'type-' || o_orderstatus AS model_type,
 CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1e6 END AS accuracy, CAST(o_orderkey % 3600 AS DOUBLE) AS duration_seconds,
 repeat(o_orderpriority, 40) AS note FROM orders)"""


@query("runs_log", f"""WITH {RUNS} SELECT run_id, experiment_name, round(accuracy, 6) AS accuracy, substr(note, 1, 250) AS note, duration_seconds FROM runs""")
def runs_log(spark, d):
    return H.runs_log(views.runs(spark, d)).select(
        "run_id", "experiment_name", F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy"),
        F.col("params")["note"].alias("note"), "duration_seconds",
    )


@query("runs_compare", f"""WITH {RUNS} SELECT run_id, model_type, round(accuracy, 6) AS metric, duration_seconds FROM runs""")
def runs_compare(spark, d):
    return H.runs_compare(H.runs_log(views.runs(spark, d)))


@query("best_run", f"""WITH {RUNS}, m AS (SELECT *, coalesce(accuracy, 0) AS a, max(coalesce(accuracy, 0)) OVER (PARTITION BY experiment_name) AS best FROM runs)
SELECT experiment_name, round(best, 6) AS best_metric, min(run_id) AS run_id FROM m WHERE a = best GROUP BY experiment_name, best""")
def best_run(spark, d):
    return H.best_run(H.runs_log(views.runs(spark, d)), ["experiment_name"])


JOBS = """je AS (SELECT 'job-' || l_orderkey AS job_id, 'm' || (l_orderkey % 3) AS model_id,
 CASE WHEN l_linenumber = 1 THEN 'pending' WHEN l_linenumber = 2 THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed' ELSE 'cancelled' END AS status,
 make_timestamp((l_orderkey * 100000 + l_linenumber * 600 + CAST(l_quantity AS BIGINT)) * 1000000) AS moment,
 CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS seq FROM lineitem),
jobs AS (SELECT job_id, model_id, arg_max(status, epoch_us(moment)::VARCHAR || status) AS status, min(moment) AS created_at, min(moment) FILTER (WHERE status = 'running') AS started_at,
 max(moment) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at FROM je GROUP BY ALL),
jobd AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM jobs)"""


@query("job_history", f"""WITH {JOBS} SELECT model_id, job_id, created_at, completed_at, round(duration_seconds, 6) AS duration_seconds,
CAST(row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, job_id) AS INTEGER) AS position FROM jobd QUALIFY position <= 50""")
def job_history(spark, d):
    return H.job_history(views.job_events(spark, d), 50).select(
        "model_id", "job_id", "created_at", "completed_at", "duration_seconds", "position"
    )


@query("job_latest_completed", f"""WITH {JOBS}, done AS (SELECT * FROM jobd WHERE status = 'completed')
SELECT model_id, job_id, completed_at FROM done QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY completed_at DESC, job_id DESC) = 1""")
def job_latest_completed(spark, d):
    return H.latest_completed(views.job_events(spark, d))


@query("job_transition_audit", f"""WITH {JOBS}, p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY moment, seq) AS previous FROM je)
SELECT job_id, seq, status, previous, CASE status WHEN 'pending' THEN previous IS NULL WHEN 'running' THEN coalesce(previous = 'pending', false) WHEN 'completed' THEN coalesce(previous = 'running', false)
 ELSE coalesce(previous IN ('pending', 'running'), false) END AS legal FROM p""")
def job_transition_audit(spark, d):
    return H.transition_audit(views.job_events(spark, d))


# Scoring ------------------------------------------------------------------

WEIGHTS = [0.002, -0.015, 0.01]
LINEAR = "(0.1e0 + f0 * 0.002e0 + f1 * -0.015e0 + f2 * 0.01e0)"
SHADOW = "(0.05e0 + f0 * 0.002e0 + f1 * -0.014e0)"
champion_score = C.linear_score(WEIGHTS, 0.1)
shadow_score = C.linear_score([0.002, -0.014], 0.05)


@query("score_mean", f"""WITH {LOGS} SELECT id, round((f0 + f1 + f2) / 3, 6) AS result, 0.99e0 AS confidence FROM logs""")
def score_mean(spark, d):
    rows = views.prediction_logs(spark, d).select("id", "features")
    return C.score_batch(rows, C.mean_score, F.lit(0.99)).drop("features")


@query("score_batch", f"""WITH {LOGS} SELECT id, model_id, round({LINEAR}, 6) + 0 AS result, round(least(1, greatest(0, 0.5e0 + {LINEAR})), 6) AS confidence FROM logs""")
def score_batch(spark, d):
    rows = views.prediction_logs(spark, d).select("id", "model_id", "features")
    return C.score_batch(rows, champion_score, 0.5 + champion_score(F.col("features"))).drop("features")


def _load_linear():
    import numpy as np

    weights = np.array(WEIGHTS)

    def predict(vectors):
        result = np.vstack(vectors.to_numpy()) @ weights + 0.1
        return result, 0.5 + result

    return predict


@query("score_external", f"""WITH {LOGS} SELECT id, model_id, round({LINEAR}, 6) + 0 AS result, round(least(1, greatest(0, 0.5e0 + {LINEAR})), 6) AS confidence FROM logs""")
def score_external(spark, d):
    rows = views.prediction_logs(spark, d).select("id", "model_id", "features")
    return C.score_external(rows, _load_linear).drop("features")


@query("postprocess_binary", f"""WITH {LOGS}, p AS (SELECT id, 1 / (1 + exp(-{LINEAR})) AS p FROM logs)
SELECT id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, round(greatest(p, 1 - p), 6) AS confidence FROM p""")
def postprocess_binary(spark, d):
    rows = views.prediction_logs(spark, d).withColumn("p", C.sigmoid(champion_score(F.col("features"))))
    prediction, confidence = C.postprocess_binary(F.col("p"))
    return rows.select("id", prediction.alias("prediction"), confidence.alias("confidence"))


@query("postprocess_argmax", """WITH m AS (SELECT vec_id, embedding[1:12] AS v FROM embeddings), p AS (SELECT *, list_max(v) AS top, list_position(v, list_max(v)) - 1 AS i FROM m)
SELECT vec_id, CAST(i AS INTEGER) AS prediction, CASE WHEN i < 10 THEN 'class-' || i ELSE CAST(i AS VARCHAR) END AS label, round(CAST(top AS DOUBLE), 6) + 0 AS confidence FROM p""")
def postprocess_argmax(spark, d):
    outputs = F.slice("embedding", 1, 12)
    index, label, confidence = C.postprocess_argmax(outputs, [f"class-{i}" for i in range(10)])
    return table(spark, d, "embeddings").select(
        "vec_id", index.alias("prediction"), label.alias("label"), confidence.cast("double").alias("confidence")
    )


@query("route_single", f"WITH {LOGS} SELECT id, model_id, 'v1' AS version FROM logs")
def route_single(spark, d):
    requests = views.prediction_logs(spark, d).select("id", "model_id", "entity_id")
    return C.route_single(requests, registry_of_two(spark, d)).select("id", "model_id", "version")


def _route_sql(salt: str, cut: int) -> str:
    chosen = f"{bucket_sql('entity_id', salt)} < {cut}"
    return f"""WITH {LOGS} SELECT id, model_id, CASE WHEN {chosen} THEN 'challenger' ELSE 'champion' END AS role,
CASE WHEN {chosen} THEN 'v2' ELSE 'v1' END AS version FROM logs"""


@query("route_ab", _route_sql("ab", 1000))
def route_ab(spark, d):
    requests = views.prediction_logs(spark, d).select("id", "model_id", "entity_id")
    return C.route_ab(requests, registry_of_two(spark, d)).select("id", "model_id", "role", "version")


@query("route_canary", _route_sql("canary", 500))
def route_canary(spark, d):
    requests = views.prediction_logs(spark, d).select("id", "model_id", "entity_id")
    return C.route_canary(requests, registry_of_two(spark, d)).select("id", "model_id", "role", "version")


@query("route_shadow", f"""WITH {LOGS}, s AS (SELECT model_id, {LINEAR} AS a, {SHADOW} AS b FROM logs)
SELECT model_id, count(*) AS requests, round(avg(CASE WHEN abs(a - b) <= 0.1 THEN 1.0e0 ELSE 0 END), 6) AS agreement_rate, round(avg(abs(a - b)), 6) AS mean_gap, round(max(abs(a - b)), 6) AS max_gap FROM s GROUP BY model_id""")
def route_shadow(spark, d):
    return C.shadow_compare(views.prediction_logs(spark, d), champion_score, shadow_score, ["model_id"], 0.1)


@query("model_for_request", f"""WITH {LOGS} SELECT id, model_id, CASE WHEN id % 3 = 0 THEN model_version WHEN id % 3 = 1 THEN NULL ELSE 'v1' END AS version FROM logs""")
def model_for_request(spark, d):
    asked = F.when(F.col("id") % 3 == 0, F.col("model_version")).when(F.col("id") % 3 == 1, F.lit("v9"))
    requests = views.prediction_logs(spark, d).select("id", "model_id", asked.alias("model_version"))
    return C.model_for_request(requests, registry_of_two(spark, d)).select("id", "model_id", "version")


@query("explain_perturbation", f"""WITH {LOGS}, m AS (SELECT id, {LINEAR} AS prediction, abs(f0 * 0.002e0) AS a, abs(f1 * -0.015e0) AS b, abs(f2 * 0.01e0) AS c FROM logs),
t AS (SELECT *, a + b + c AS t FROM m),
l AS (SELECT id, prediction, 'value' AS feature, 0 AS place, CASE WHEN t > 0 THEN round(a / t, 4) ELSE a END AS importance FROM t
 UNION ALL SELECT id, prediction, 'counter', 1, CASE WHEN t > 0 THEN round(b / t, 4) ELSE b END FROM t
 UNION ALL SELECT id, prediction, 'hour', 2, CASE WHEN t > 0 THEN round(c / t, 4) ELSE c END FROM t)
SELECT id, round(prediction, 6) + 0 AS prediction, string_agg(feature, ',' ORDER BY importance DESC, place) AS top_features, round(max(importance), 4) AS top_importance FROM l GROUP BY id, prediction""")
def explain_perturbation(spark, d):
    rows = views.prediction_logs(spark, d).select("id", "features")
    out = C.explain_perturbation(rows, champion_score, ["value", "counter", "hour"])
    return out.select(
        "id", "prediction", F.concat_ws(",", "top_features").alias("top_features"),
        F.col("importances")[0]["importance"].alias("top_importance"),
    )


def _cache_log(spark, d):
    """Requests of a coarse feature, so that keys repeat."""
    coarse = F.array(F.floor(F.col("features")[0] / 50).cast("double"))
    return views.prediction_logs(spark, d).withColumn("features", coarse).select(
        "id", "model_id", "model_version", "features", "created_at"
    )


DEDUP = f"""WITH RECURSIVE {LOGS}, q AS MATERIALIZED (SELECT id, model_id, model_version, floor(f0 / 50) AS f, epoch_us(created_at) AS us,
 row_number() OVER (PARTITION BY model_id, model_version, floor(f0 / 50) ORDER BY created_at, id) AS n FROM logs),
nx AS MATERIALIZED (SELECT a.model_id, a.model_version, a.f, a.n, min(b.n) AS next FROM q a JOIN q b ON a.model_id = b.model_id AND a.model_version = b.model_version AND a.f = b.f AND a.us + 14400000000 < b.us GROUP BY ALL),
miss(model_id, model_version, f, n) AS (SELECT model_id, model_version, f, n FROM q WHERE n = 1
 UNION ALL SELECT m.model_id, m.model_version, m.f, x.next FROM miss m JOIN nx x ON m.model_id = x.model_id AND m.model_version = x.model_version AND m.f = x.f AND m.n = x.n)"""


@query("request_dedup", f"""{DEDUP} SELECT q.id, q.model_id, m.n IS NULL AS hit FROM q LEFT JOIN miss m ON q.model_id = m.model_id AND q.model_version = m.model_version AND q.f = m.f AND q.n = m.n""")
def request_dedup(spark, d):
    return C.request_dedup(_cache_log(spark, d), 14400).select("id", "model_id", "hit")


@query("cache_counts", f"""{DEDUP} SELECT q.model_id, count(*) FILTER (WHERE m.n IS NULL) AS hits, count(*) FILTER (WHERE m.n IS NOT NULL) AS misses
FROM q LEFT JOIN miss m ON q.model_id = m.model_id AND q.model_version = m.model_version AND q.f = m.f AND q.n = m.n GROUP BY q.model_id""")
def cache_counts(spark, d):
    return C.cache_counts(C.request_dedup(_cache_log(spark, d), 14400), ["model_id"])


# Training: rows-only checks; fits use fewer rounds than the library defaults. ---

CREDIT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _credit(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(key.alias("row_key"), *CREDIT, (F.col("l_returnflag") == "R").cast("int").alias("label"))


def _fraud(spark, d):
    e = views.events(spark, d)
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("double")
    return e.select(
        "event_id", "value", k.alias("k"), F.hour("ts").cast("double").alias("hour"),
        F.dayofweek("ts").cast("double").alias("weekday"), (F.col("event_type") == "error").cast("int").alias("label"),
    )


@query("train_credit")
def train_credit(spark, d):
    return T.train_credit(_credit(spark, d), "row_key", CREDIT, "label").metrics


SIDES = """SELECT is_test, label, CAST(CASE WHEN is_test THEN round(n * 0.2e0) ELSE n - round(n * 0.2e0) END AS BIGINT) AS n
FROM classes, (VALUES (true), (false)) s(is_test) WHERE CASE WHEN is_test THEN round(n * 0.2e0) ELSE n - round(n * 0.2e0) END > 0"""


@query("train_credit_sides", f"WITH classes AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS label, count(*) AS n FROM lineitem GROUP BY ALL) {SIDES}")
def train_credit_sides(spark, d):
    return T.training_sides(_credit(spark, d), "row_key", "label")


@query("train_fraud_sides", f"WITH classes AS (SELECT CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END AS label, count(*) AS n FROM events GROUP BY ALL) {SIDES}")
def train_fraud_sides(spark, d):
    return T.training_sides(_fraud(spark, d), "event_id", "label")


@query("train_house_sides", "SELECT is_test, CAST(CASE WHEN is_test THEN round(n * 0.2e0) ELSE n - round(n * 0.2e0) END AS BIGINT) AS n FROM (SELECT count(*) AS n FROM part), (VALUES (true), (false)) s(is_test)")
def train_house_sides(spark, d):
    return T.training_sides(table(spark, d, "part"), "p_partkey", "p_retailprice", False)


def _summed(reference):
    return reference.groupBy("feature_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


SUMMED = "count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high"


@query("train_fraud_reference", f"""WITH r AS (SELECT value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS h, CAST(dayofweek(ts) + 1 AS DOUBLE) AS w,
 row_number() OVER (PARTITION BY event_type = 'error' ORDER BY {hash_sql("event_id", 42)}, event_id) AS place, count(*) OVER (PARTITION BY event_type = 'error') AS n FROM events),
train AS (SELECT * FROM r WHERE place > round(n * 0.2e0)),
long AS (SELECT 'value' AS feature_name, value FROM train UNION ALL SELECT 'k', k FROM train UNION ALL SELECT 'hour', h FROM train UNION ALL SELECT 'weekday', w FROM train)
SELECT feature_name, {SUMMED} FROM long GROUP BY feature_name""")
def train_fraud_reference(spark, d):
    return _summed(T.training_reference(_fraud(spark, d), "event_id", ["value", "k", "hour", "weekday"], "label"))


@query("train_house_reference", f"""WITH r AS (SELECT p_size, p_partkey, row_number() OVER (ORDER BY {hash_sql("p_partkey", 42)}, p_partkey) AS place, count(*) OVER () AS n FROM part),
train AS (SELECT * FROM r WHERE place > round(n * 0.2e0)),
long AS (SELECT 'p_size' AS feature_name, CAST(p_size AS DOUBLE) AS value FROM train UNION ALL SELECT 'key', CAST(p_partkey AS DOUBLE) FROM train)
SELECT feature_name, {SUMMED} FROM long GROUP BY feature_name""")
def train_house_reference(spark, d):
    part = table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("double"))
    return _summed(T.training_reference(part, "p_partkey", ["p_size", "key"], "p_retailprice", False))


@query("train_house")
def train_house(spark, d):
    part = table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("double"))
    return T.train_house(part, "p_partkey", ["p_size", "key"], "p_retailprice").metrics


@query("train_fraud")
def train_fraud(spark, d):
    return T.train_fraud(_fraud(spark, d), "event_id", ["value", "k", "hour", "weekday"], "label").metrics


@query("train_sentiment")
def train_sentiment(spark, d):
    return T.train_sentiment(views.rated_documents(spark, d), "doc_id", "text", "quality").metrics


@query("train_image")
def train_image(spark, d):
    rows = table(spark, d, "embeddings")
    classes = rows.agg(F.max("label")).first()[0] + 1
    return T.train_image(rows, "vec_id", "embedding", "label", int(classes), 64).metrics


@query("train_challenger")
def train_challenger(spark, d):
    return T.train_challenger(_credit(spark, d), "row_key", CREDIT, "label").metrics


def _logistic_rows(spark, d):
    return T.assemble(_fraud(spark, d), ["value", "k", "hour"], "label", "event_id")


@query("cv_scores")
def cv_scores(spark, d):
    return T.cv_summary(T.cv_scores(_logistic_rows(spark, d), "event_id", LogisticRegression(), folds=5, repeats=3))


FOLDS = "fold AS (SELECT (row_number() OVER (PARTITION BY event_type = 'error' ORDER BY event_id) - 1) % {n} AS fold FROM events)"


@query("cv_held_out", f"WITH {FOLDS.format(n=3)}, r AS (SELECT unnest([0, 1]) AS repeat) SELECT repeat, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM fold, r GROUP BY ALL")
def cv_held_out(spark, d):
    return T.cv_scores(_logistic_rows(spark, d), "event_id", LogisticRegression(maxIter=5), folds=3, repeats=2).select("repeat", "fold", "n")


GRID = {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}


@query("hpo_cv")
def hpo_cv(spark, d):
    return T.hpo_cv(_logistic_rows(spark, d), "event_id", LogisticRegression(), T.grid_trials(GRID, 20))


@query("hpo_halving", f"""WITH {FOLDS.format(n=4)}, s AS (SELECT fold, count(*) AS n FROM fold GROUP BY fold), t(folds, trials) AS (VALUES (1, 3), (2, 1), (4, 2))
SELECT CAST(folds AS INTEGER) AS folds, CAST(trials AS BIGINT) AS trials, CAST(trials * (SELECT sum(n) FROM s WHERE fold < folds) AS BIGINT) AS held_out FROM t""")
def hpo_halving(spark, d):
    trials = T.grid_trials(GRID, 20)
    report = T.hpo_cv(_logistic_rows(spark, d), "event_id", LogisticRegression(maxIter=5), trials, folds=4, halving=2)
    return report.groupBy("folds").agg(F.count("*").alias("trials"), F.sum("held_out").alias("held_out"))


# The stored reference is moved, so that the recent logs have drifted from it.
HEALING = f"""WITH {LOGS}, {REGISTRY},
moved AS (SELECT model_id, feature_name, value, is_ref FROM (
 SELECT model_id, unnest(['feature_0', 'feature_1', 'feature_2']) AS feature_name, unnest([f0 * 3, f1 * 3, f2 * 3]) AS value, true AS is_ref FROM logs WHERE model_id = 'm1' AND is_ref
 UNION ALL SELECT model_id, unnest(['feature_0', 'feature_1', 'feature_2']), unnest([f0, f1, f2]), false FROM logs WHERE model_id = 'm1')),
{ks_sql('moved', ['model_id', 'feature_name'], 'ks')},
worst AS (SELECT max(statistic) AS score FROM ks WHERE p < 0.05 AND sample_size >= 5),
fired AS (SELECT CAST(count(*) FILTER (WHERE score > threshold) AS BIGINT) AS alerts FROM worst, (VALUES (0.3e0), (0.1e0)) r(threshold)),
fresh AS (SELECT ground_truth, count(*) AS n FROM logs WHERE model_id = 'm1' AND ground_truth IS NOT NULL GROUP BY ground_truth),
sizes AS (SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(round(n * 0.2e0)) AS BIGINT) AS tested FROM fresh),
own_state AS (SELECT * FROM state WHERE model_id = 'model-1'),
back AS (SELECT version, uri, row_number() OVER (ORDER BY version) AS place FROM own_state WHERE stage = 'challenger'),
last AS (SELECT max(seq) AS seq FROM ev),
made AS (SELECT last.seq + place AS seq, 'rollback' AS action, version, CAST(NULL AS VARCHAR) AS stage, uri FROM back, last
 UNION ALL SELECT last.seq + (SELECT count(*) FROM back) + 1, 'save', 'v1706745600', 'challenger', 'models/m1/v1706745600/model' FROM last)"""


def _healed(spark, d):
    from driftwell.plans.catalog.drifts import stored_reference
    from driftwell.plans.checks import ModelConfig
    from driftwell.plans.healing import self_heal

    reference = stored_reference(spark, d).withColumn("value", F.col("value") * 3)
    registry = views.registry_events(spark, d).withColumn("model_id", F.regexp_replace("model_id", "^model-", "m"))
    return self_heal(reference, views.prediction_logs(spark, d), ModelConfig("m1"), 3, registry=registry)


@query("self_healing_job", f"""{HEALING} SELECT CAST(seq AS BIGINT) AS seq, action, version, stage, uri, alerts, samples AS total_samples, tested AS n, true AS triggered FROM made, fired, sizes""")
def self_healing_job(spark, d):
    healed = _healed(spark, d)
    n = healed.trained.metrics.select(F.col("n").cast("bigint")).scalar()
    events = healed.rollbacks.unionByName(healed.saved).select("seq", "action", "version", "stage", "uri")
    return events.withColumns({
        "alerts": healed.alerts.agg(F.count("*")).scalar(), "total_samples": F.lit(healed.sizes["total_samples"]).cast("bigint"),
        "n": n, "triggered": F.lit(healed.triggered),
    })


@query("self_healing_state", f"""{HEALING} SELECT version, CASE WHEN stage = 'challenger' THEN 'archived' ELSE stage END AS stage, stage NOT IN ('archived', 'retired', 'challenger') AS is_active FROM own_state
UNION ALL SELECT version, stage, true FROM made WHERE action = 'save'""")
def self_healing_state(spark, d):
    return _healed(spark, d).state.filter("model_id = 'm1'").select("version", "stage", "is_active")
