import pytest
from pyspark.sql import functions as F

from driftwell.operators import logs as L
from driftwell.operators import scoring as C
from driftwell.operators import store as S

STORE = "entity_id string, feature string, value double, ts int, expires int"


def store(spark, rows):
    return spark.createDataFrame(rows, STORE).select(
        "entity_id", "feature", "value", F.timestamp_seconds("ts").alias("event_ts"),
        F.timestamp_seconds("expires").alias("expires_at"),
    )


def test_online_features(spark):
    s = store(spark, [("e1", "age", 30.0, 1, None), ("e1", "income", 50000.0, 1, None), ("e1", "age", 31.0, 2, None), ("e2", "x", 1.0, 1, None)])
    asked = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "entity_id string")
    got = {r["entity_id"]: r["features"] for r in S.online_features(asked, s, ["income", "age", "debt"]).collect()}
    assert got == {"e1": [50000.0, 31.0, 0.0], "e2": None, "e3": None}


def test_ttl_delete_list(spark):
    s = store(spark, [("a", "f", 1.0, 0, 100), ("b", "f", 1.0, 0, None), ("c", "f", 1.0, 0, 5), ("c", "g", 1.0, 1, None)])
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    ttl = {r["entity_id"]: r["ttl"] for r in S.ttl_seconds(s, asked, F.timestamp_seconds(F.lit(10))).collect()}
    assert ttl == {"a": 90, "b": -1, "c": -2, "d": -2}
    gone = spark.createDataFrame([("a",), ("zz",)], "entity_id string")
    assert S.deleted_count(s, gone).first()["deleted"] == 1
    assert S.delete_entities(s, gone).select("entity_id").distinct().count() == 2
    assert [r[0] for r in S.list_entities(s, "", 2).collect()] == ["a", "b"]


@pytest.mark.parametrize("chunks", [1, 4])
def test_point_in_time_never_looks_ahead(spark, chunks):
    s = store(spark, [("e", "f", float(t), t, None) for t in range(0, 100, 10)] + [("e", "g", 7.0, 55, None), ("h", "f", 1.0, 5, None)])
    labels = spark.createDataFrame([("e", 1, 0), ("e", 2, 9), ("e", 3, 55), ("e", 4, 500), ("h", 5, 1)], "entity_id string, label_id int, t int").select(
        "entity_id", "label_id", F.timestamp_seconds("t").alias("ts")
    )
    got = {r["label_id"]: (r["f"], r["g"]) for r in S.historical_features(labels, s, ["f", "g"], chunks=chunks).collect()}
    assert got == {1: (0.0, None), 2: (0.0, None), 3: (50.0, 7.0), 4: (90.0, 7.0), 5: (None, None)}
    aged = {r["label_id"]: r["f"] for r in S.historical_features(labels, s, ["f"], 20, chunks).collect()}
    assert aged[4] is None and aged[3] == 50.0


def test_request_validation(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, "m", [1.0, 2.0]), (2, "m", []), (3, "m", [nan, inf]), (4, "m", [9.0]), (5, "m", None)], "id int, model_id string, features array<double>")
    errors = L.request_errors("features", "model_id", 2, None, {"a": (0.0, 5.0)}, max_features=3)
    got = {r["id"]: r["e"] for r in df.select("id", errors.alias("e")).collect()}
    assert got[1] == [] and got[2] == got[5] == ["Features list cannot be empty"]
    assert got[3] == ["Feature at index 0 is NaN", "Feature at index 1 is infinite"]
    assert got[4] == ["Feature count mismatch: got 1, expected 2 for model m", "Feature 'a' value 9.0 out of range [0.0, 5.0]"]


def test_versions(spark):
    df = spark.createDataFrame([("m", "1.2.0"), ("m", "1.10.0"), ("m", "v9"), ("m", None)], "model_id string, version string")
    assert L.latest_version(df, ["model_id"]).first()["latest_version"] == "1.10.0"
    assert L.rejected_versions(df).count() == 2


def test_routing_shares_and_roles(spark):
    models = spark.createDataFrame(
        [("m", "v1", "champion", True, 1), ("m", "v2", "challenger", True, 2), ("s", "v1", "champion", True, 1), ("s", "v0", "challenger", False, 0)],
        "model_id string, version string, stage string, is_active boolean, created_at int",
    )
    requests = spark.range(20000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'm' ELSE 's' END AS model_id", "id AS entity_id")
    ab = C.route_ab(requests, models, 0.1).groupBy("model_id", "version").count().collect()
    share = {(r["model_id"], r["version"]): r["count"] for r in ab}
    assert share[("s", "v1")] == 10000 and share[("m", "v2")] == pytest.approx(1000, rel=0.15)
    canary = C.route_canary(requests, models, 0.0)
    assert canary.filter("role = 'challenger'").count() == 0 and canary.count() == 20000
    with pytest.raises(ValueError):
        C.route_ab(requests, models, 1.5)


def test_postprocess_and_explain(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],)], "o array<double>")
    index, label, confidence = C.postprocess_argmax(F.col("o"), ["a"])
    assert tuple(df.select(index, label, confidence).first()) == (1, "1", 0.7)
    rows = spark.createDataFrame([([1.0, -2.0, 0.0],), ([0.0, 0.0, 0.0],)], "features array<double>")
    out = C.explain_perturbation(rows, C.linear_score([1.0, 1.0, 5.0]), ["x", "y", "z"], top=2).collect()
    assert out[0]["top_features"] == ["y", "x"]
    assert [i["importance"] for i in out[0]["importances"]] == [0.6667, 0.3333, 0.0]
    assert [i["feature"] for i in out[1]["importances"]] == ["x", "y", "z"]


def test_explain_agrees_with_sql_near_a_tie(spark):
    # 0.915 of 1.1712 is 0.78125, which the terms as doubles just miss.
    rows = spark.createDataFrame([([28.1, 61.0, 20.0],)], "features array<double>")
    out = C.explain_perturbation(rows, C.linear_score([0.002, -0.015, 0.01], 0.1), ["a", "b", "c"]).first()
    assert [(i["feature"], i["importance"]) for i in out["importances"]] == [("b", 0.7812), ("c", 0.1708), ("a", 0.048)]
    # A scorer that does not know its moves is perturbed.
    out = C.explain_perturbation(rows, lambda x: F.get(x, F.lit(1)) * F.get(x, F.lit(2)), ["a", "b", "c"]).first()
    assert [(i["feature"], i["importance"]) for i in out["importances"]] == [("b", 0.5), ("c", 0.5), ("a", 0.0)]


@pytest.mark.parametrize("chunks", [1, 3])
def test_cache_hits_do_not_extend(spark, chunks):
    rows = [(i, "m", "v", [1.0], t) for i, t in enumerate([0, 200, 300, 301, 600, 602])]
    logs = spark.createDataFrame(rows, "id int, model_id string, model_version string, features array<double>, t int").withColumn(
        "created_at", F.timestamp_seconds("t")
    )
    got = {r["id"]: r["hit"] for r in C.request_dedup(logs, 300, chunks).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}


@pytest.mark.parametrize("chunks", [1, 3])
def test_rolling_flags_match_a_plain_count(spark, chunks):
    times = [0, 10, 59, 60, 61, 119, 120, 500]
    logs = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "id int, key string, t int").withColumn(
        "created_at", F.timestamp_seconds("t")
    )
    got = {r["id"]: r["requests_in_window"] for r in L.rolling_request_flags(logs, "key", 2, chunks=chunks).collect()}
    assert got == {i: sum(1 for u in times if t - 60 < u <= t) for i, t in enumerate(times)}


def test_feedback_latest_wins(spark):
    logs = spark.createDataFrame([(1, None), (2, 0.0)], "id int, ground_truth double")
    given = spark.createDataFrame([(1, 1.0, 5), (1, 0.0, 9)], "id int, ground_truth double, received_at int")
    assert {tuple(r) for r in L.attach_feedback(logs, given).collect()} == {(1, 0.0), (2, 0.0)}
