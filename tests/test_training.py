from driftwell.operators import training as T
from driftwell.plans.checks import ModelConfig
from driftwell.operators.splits import kfold
from __spark_entry__ import queries


def blobs(spark):
    return spark.range(400).selectExpr("id", "id % 2 AS y", "double(id % 2) * 4 + rand(1) AS a", "rand(2) AS b")


def test_challenger_learns(spark):
    row = T.train_challenger(blobs(spark), "id", ["a", "b"], "y", iterations=10).metrics.first()
    assert row["n"] == 80 and row["accuracy"] == 1.0 and row["auc"] == 1.0


def test_credit_learns(spark):
    assert T.train_credit(blobs(spark), "id", ["a", "b"], "y", trees=3).metrics.first()["f1_score"] == 1.0


def test_house_learns(spark):
    df = spark.range(300).selectExpr("id", "double(id % 10) AS a", "double(id % 10) * 3 AS y")
    assert T.train_house(df, "id", ["a"], "y", trees=10).metrics.first()["r2"] > 0.9


def test_trees_learn_from_cells_whatever_the_rows(spark, monkeypatch):
    seen, keep = [], T.kept
    monkeypatch.setattr(T, "kept", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(4000).selectExpr("id", "double(id % 10) AS a", "double(id % 7) AS b", "double(id % 10) * 3 + id % 7 AS y")
    row = T.train_house(df, "id", ["a", "b"], "y", trees=5).metrics.first()
    assert (seen[0].count(), seen[0].agg({"_mass": "sum"}).first()[0]) == (70, 3200.0)
    assert row["n"] == 800 and row["r2"] > 0.9
    # Few cells are dealt into shares, so that samples of rows stay samples.
    T.train_fraud(df.withColumn("y", df.a == 1), "id", ["a", "b"], "y", trees=2)
    assert seen[1].count() > 2000


def test_leaves_count_rows_not_cells(spark):
    from pyspark.ml.classification import GBTClassifier

    df = spark.range(100).selectExpr("double(id >= 96) AS a", "double(id >= 96) AS label")
    nodes = [T.fit_trees(df, ["a"], GBTClassifier(maxIter=1, maxDepth=1), least=n).stages[-1].totalNumNodes for n in (4, 5)]
    assert nodes == [3, 1]


def test_edges_are_between_values_or_at_quantiles(spark):
    rows = spark.range(10000).selectExpr("double(id % 4) AS few", "double(id) AS many", "1.0D AS one")
    edges = T._edges(rows, ["few", "many", "one"], 4)
    assert edges["few"] == [0.5, 1.5, 2.5] and edges["one"] == []
    assert all(abs(a - b) <= 20 for a, b in zip(edges["many"], (2500, 5000, 7500), strict=True))


def test_sides_are_split_once(spark):
    trained = T.train_challenger(blobs(spark), "id", ["a", "b"], "y", iterations=3)
    plan = trained.reference._jdf.queryExecution().optimizedPlan().toString() + trained.scored._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and trained.scored.count() == trained.scored.select("id").distinct().count() == 80


def test_weights(spark):
    rows = T.weighted_rows(spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "label double"))
    assert {tuple(r) for r in rows.collect()} == {(0.0, 1.0), (1.0, 3.0)}


def test_search_spaces():
    grid = T.grid_trials({"a": [1, 2], "b": [3, 4]}, 3)
    assert grid == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}]
    draws = T.random_trials({"n": (50, 500), "lr": (0.01, 0.3), "kind": ["x", "y"]}, 5)
    assert draws == T.random_trials({"n": (50, 500), "lr": (0.01, 0.3), "kind": ["x", "y"]}, 5)
    assert all(50 <= d["n"] <= 500 and 0.01 <= d["lr"] <= 0.3 for d in draws)


def test_hpo_orders_trials(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = T.assemble(blobs(spark), ["a", "b"], "y", "id")
    best = T.hpo_cv(rows, "id", LogisticRegression(maxIter=5), [{"regParam": 100.0, "elasticNetParam": 1.0}, {"regParam": 0.0}], folds=2)
    assert [r["trial"] for r in best.collect()] == [1, 0]


def test_all_trials_are_reported_and_halving_agrees_where_it_goes_on(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = T.assemble(blobs(spark), ["a", "b"], "y", "id")
    trials = [{"regParam": r} for r in (100.0, 0.0, 50.0, 0.01)]
    full = {r.trial: r for r in T.hpo_cv(rows, "id", LogisticRegression(maxIter=5), trials, folds=4).collect()}
    assert set(full) == {0, 1, 2, 3} and all(r.folds == 4 and r.held_out == 400 for r in full.values())
    half = T.hpo_cv(rows, "id", LogisticRegression(maxIter=5), trials, folds=4, halving=2).collect()
    assert [(r.folds, r.held_out) for r in half] == [(4, 400), (2, 200), (1, 100), (1, 100)]
    assert half[0].score == full[half[0].trial].score == max(r.score for r in full.values())
    assert T.hpo_cv(rows, "id", LogisticRegression(maxIter=5), trials, folds=4, top=2, workers=1).count() == 2


def test_cross_validation_of_all_repeats(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = T.assemble(blobs(spark), ["a", "b"], "y", "id")
    scores = T.cv_scores(rows, "id", LogisticRegression(maxIter=5), folds=4, repeats=3).collect()
    assert [(r.repeat, r.fold) for r in scores] == [(r, f) for r in range(3) for f in range(4)]
    assert all(r.n == 100 and r.accuracy == 1.0 for r in scores)


def test_repeats_are_one_scan(spark, tiny):
    from driftwell.operators.splits import repeated_kfold

    orders = spark.read.parquet(f"{tiny}/orders.parquet").select("o_orderkey", "o_orderstatus")
    many = repeated_kfold(orders, "o_orderkey", "o_orderstatus", 5, 3)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("parquet") == repeated_kfold(orders, "o_orderkey", "o_orderstatus", 5, 1)._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    for r in range(3):
        want = kfold(orders, "o_orderkey", "o_orderstatus", 5, 42 + r).orderBy("o_orderkey").collect()
        assert [x.fold for x in many.filter(f"repeat = {r}").orderBy("o_orderkey").collect()] == [x.fold for x in want]


def test_training_leaves_its_reference(spark):
    trained = T.train_challenger(blobs(spark), "id", ["a", "b"], "y", iterations=3)
    kept = {r.feature_name: r.n for r in trained.reference.groupBy("feature_name").count().withColumnRenamed("count", "n").collect()}
    assert kept == {"a": 320, "b": 320}
    same = T.training_reference(blobs(spark), "id", ["a", "b"], "y", seed=99)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, trained.reference.collect()))
    assert {(r.is_test, r.label): r.n for r in T.training_sides(blobs(spark), "id", "y").collect()} == {(s, c): n for s, n in ((True, 40), (False, 160)) for c in (0.0, 1.0)}


def test_sentiment_and_image_run(spark, tiny):
    assert queries()["train_sentiment"](spark, tiny).first()["n"] > 0
    assert queries()["train_image"](spark, tiny).first()["n"] > 0


def test_sentiment_splits_without_texts(spark, monkeypatch):
    written, once = [], T._once
    monkeypatch.setattr(T, "_once", lambda df, label: written.append(df.columns) or once(df, label))
    docs = spark.range(60).selectExpr("id", "if(id % 2 = 0, 'good fine text', 'bad poor text') AS text", "id % 2 AS y")
    row = T.train_sentiment(docs, "id", "text", "y", max_features=20, iterations=3).metrics.first()
    assert written == [["id", "label", "is_test"]] and (row["n"], row["accuracy"]) == (12, 1.0)


def test_task_defaults():
    assert ModelConfig("x", "regression").drift_test == "wasserstein"
    assert ModelConfig("x", "object_detection").monitor_drift is False
    assert ModelConfig("x", "unknown").primary_metric == "accuracy"
    assert ModelConfig("x", "nlp", drift_test="psi").drift_test == "psi"


def test_folds_cover_everything(spark):
    assert kfold(blobs(spark), "id", "y").count() == 400
