import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions.text import _plain
from driftwell.operators import quality as Q
from driftwell.operators import splits as S
from driftwell.operators import textfeatures
from driftwell.operators import transforms as T
from driftwell.operators.textfeatures import terms, vocabulary
from driftwell.plans import exports
from driftwell.sources import tables as I
from driftwell.session import scratch_path


def issues(df, **kw):
    return {(r["column"], r["issue_type"]): r for r in Q.quality_issues(df, **kw).collect()}


def test_quality_fixtures(spark):
    clean = spark.createDataFrame([(50000, 25, 10, 0), (60000, 35, 20, 1), (70000, 45, 30, 0), (55000, 30, 15, 1), (65000, 40, 25, 1)],
                                  "income int, age int, debt int, target int")
    assert issues(clean, target="target") == {}
    assert Q.column_profile(clean).count() == 4
    nulls = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (None, 4), (1.0, 5)], "a double, b int")
    found = issues(nulls)[("a", "high_null_rate")]
    assert found["severity"] == "error" and found["message"] == "a has 80.0% null values (threshold: 30.0%)"
    few = spark.createDataFrame([(float("nan"), 1), (2.0, 2), (3.0, 3), (4.0, 4), (5.0, 5)], "a double, b int")
    assert issues(few)[("a", "has_nulls")]["severity"] == "warning"
    dups = spark.createDataFrame([(1, 10)] * 3 + [(2, 20), (3, 30)], "a int, b int")
    assert issues(dups)[("*", "high_duplicates")]["message"] == "Dataset has 2 duplicate rows (40.0%)"
    out = spark.createDataFrame([(i,) for i in range(100)] + [(99999,)], "val int")
    for chunks in (1, 3):
        row = Q.check_outliers(out, chunks=chunks).first()
        assert row["message"] == "val has 1 outlier(s) beyond 3.0×IQR" and row["severity"] == "info"
    ages = spark.createDataFrame([(25, 1), (150, 2)], "age int, income int")
    assert issues(ages, ranges={"age": (0, 120), "gone": (0, 1)})[("age", "out_of_range")]["message"] == "age: 1 values outside [0, 120]"
    constant = spark.createDataFrame([(1, 0), (2, 0)], "a int, target int")
    assert issues(constant, target="target")[("target", "constant_target")]["severity"] == "error"
    empty = spark.createDataFrame([], "a int, target int")
    assert list(issues(empty, target="target", ranges={"a": (0, 1)})) == [("*", "empty_dataset")]


def test_gate_and_cleaning(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (None, None, None), (3.0, 4, None)], "a double, b bigint, c string")
    gate = Q.overall_null_gate(df).first()
    assert gate["null_percent"] == 55.56 and not gate["validation_passed"]
    for chunks in (1, 3):
        rows = sorted(tuple(r) for r in Q.clean_basic(df, chunks).collect())
        assert rows == [(1.0, 4.0, "x"), (3.0, 4.0, None)] or [r[:2] for r in rows] == [(1.0, 4.0), (3.0, 4.0)]


def test_ingest(spark):
    good = spark.createDataFrame([(float(i), i % 7, i % 2) for i in range(30)], "income double, age int, target int")
    path = scratch_path(spark, "t") + ".parquet"
    done = exports.ingest(good, "target", path=path)
    assert done.success and done.rows_stored == 30 and spark.read.parquet(path).count() == 30
    bad = spark.createDataFrame([(None, 1, 0), (None, 2, 1), (None, 3, 0), (1.0, 4, 1), (2.0, 5, 1)], "income double, age int, target int")
    failed = exports.ingest(bad, "target")
    assert not failed.success and failed.errors == ["Validation failed: 1 error(s)"] and failed.cleaned is None


def test_export(spark):
    logs = spark.createDataFrame(
        [(i, "m", [float(i), 1.0], 1.0, 0.9, float(i % 2) if i % 3 else None, i) for i in range(9)],
        "id int, model_id string, features array<double>, result double, confidence double, ground_truth double, created int",
    ).withColumn("created_at", F.timestamp_seconds("created"))
    base = spark.createDataFrame([(1.0, 2.0, 0.0)], "a double, b double, target double")
    out = exports.export_training(logs, 2, base)
    assert out.columns == ["a", "b", "target", "origin"]
    assert exports.require_samples(out, 7) == {"total_samples": 7, "fresh_samples": 6, "baseline_samples": 1}
    with pytest.raises(ValueError, match=r"Insufficient data: 7 samples \(need 500\). Fresh: 6, baseline: 1."):
        exports.require_samples(out)
    wide = exports.export_training(logs, 2, base.withColumn("c", F.lit(1.0)).select("a", "b", "c", "target"))
    assert "feature_0" in wide.columns and wide.filter("origin = 'fresh' AND a IS NULL").count() == 6


def test_transforms(spark):
    df = spark.createDataFrame([(10.0, 20.0, "A"), (20.0, 30.0, "B"), (30.0, 40.0, "A"), (40.0, 50.0, "C")], "income double, age double, category string")
    scaled = [r[0] for r in T.StandardScaler(["income"]).fit_transform(df).select("income").collect()]
    assert np.mean(scaled) == pytest.approx(0) and np.std(scaled, ddof=1) == pytest.approx(1)
    unit = [r[0] for r in T.MinMaxScaler(["income"]).fit_transform(df).select("income").collect()]
    assert min(unit) == 0.0 and max(unit) == 1.0
    hot = T.OneHotEncoder(["category"]).fit_transform(df)
    assert hot.columns == ["income", "age", "category_B", "category_C"]
    assert T.OneHotEncoder(["category"], drop_first=False).fit_transform(df).columns[2:] == ["category_A", "category_B", "category_C"]
    gaps = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "a double")
    fill = lambda s, v=0.0: sorted(r[0] for r in T.Imputer(s, v).fit_transform(gaps).collect())
    assert fill("median") == [1.0, 2.0, 2.0, 4.0] and fill("constant", -1.0) == [-1.0, 1.0, 2.0, 4.0]
    assert fill("mean")[2] == pytest.approx(7 / 3)
    logs = T.LogTransform(["a"]).fit_transform(spark.createDataFrame([(-5.0,), (None,), (1.0,)], "a double")).collect()
    assert [r[0] for r in logs] == [0.0, None, pytest.approx(math.log(2))]
    chain = T.TransformChain([T.Imputer("mean", columns=["income"])]).add(T.StandardScaler(["income"]))
    assert chain.describe() == [{"step": 0, "type": "Imputer"}, {"step": 1, "type": "StandardScaler"}]
    ordinal = T.OrdinalEncoder(["category"]).fit(df)
    unseen = spark.createDataFrame([("C",), ("Z",), (None,)], "category string")
    assert [r[0] for r in ordinal.transform(unseen).collect()] == [2, -1, -1]
    flat = T.MinMaxScaler(["a"]).fit_transform(spark.createDataFrame([(3.0,), (None,)], "a double")).collect()
    assert [r[0] for r in flat] == [0.0, 0.0]


def test_many_categories_have_code_tables(spark):
    values = [None, "b", "a", "ä", "B", "zz", "a", None, "0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    few, many = T.OrdinalEncoder(["c"]), T.OrdinalEncoder(["c"], inline=3)
    assert few.fit_transform(df).collect() == many.fit_transform(df).orderBy("id").collect()
    assert many.tables and not many.seen and many.transform(df).columns == df.columns
    other = spark.createDataFrame([(1, "new"), (2, "b")], "id int, c string")
    assert {r.id: r.c for r in many.transform(other).collect()} == {1: -1, 2: sorted(set(filter(None, values))).index("b")}
    assert T.label_encode(df, "c", inline=2).orderBy("id").collect() == T.label_encode(df, "c").orderBy("id").collect()


@pytest.mark.parametrize("drop_first", [True, False])
def test_wide_one_hot_becomes_a_sparse_vector(spark, drop_first):
    values = [None, "b", "a", "c", "d", "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    columns = T.OneHotEncoder(["c"], drop_first).fit_transform(df).orderBy("id").collect()
    sparse = T.OneHotEncoder(["c"], drop_first, wide=2).fit_transform(df)
    assert sparse.columns == ["id", "c_onehot"]
    for wide, row in zip(columns, sparse.orderBy("id").collect()):
        dense = [0] * row.c_onehot.size
        for place, value in zip(row.c_onehot.indices, row.c_onehot["values"]):
            dense[place] = int(value)
        assert dense == list(wide[1:])


def test_a_million_categories(spark):
    df = spark.range(1_000_000).selectExpr("id", "lpad(cast(id * 7919 % 1000000 as string), 7, '0') AS c")
    out = T.OrdinalEncoder(["c"]).fit_transform(df)
    assert out.filter("c != id * 7919 % 1000000").count() == 0
    assert T.OneHotEncoder(["c"]).fit_transform(df).filter("get(c_onehot.indices, 0) = id * 7919 % 1000000 - 1").count() == 999_999



@pytest.mark.parametrize("bits", [4, 12])
def test_split_is_exact_disjoint_and_stratified(spark, bits, monkeypatch):
    monkeypatch.setattr(S, "_cell_bits", lambda df: bits)
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS label")
    split = S.train_test_split(df, "id", "label")
    counts = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {("a", True): 67, ("a", False): 267, ("b", True): 133, ("b", False): 533}
    assert split.select("id").distinct().count() == 1000
    again = S.train_test_split(df.repartition(5), "id", "label")
    assert set(split.filter("is_test").collect()) == set(again.filter("is_test").collect())
    assert S.sample_n(df, "id", 137).count() == 137 and S.sample_n(df, "id", 5000).count() == 1000
    folds = S.kfold(df, "id", "label").groupBy("label", "fold").count().collect()
    for label in "ab":
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_many_labels_are_not_stratified(spark):
    df = spark.range(100).selectExpr("id", "id AS label")
    assert S.train_test_split(df, "id", "label", max_classes=20).filter("is_test").count() == 20
    # By default every class gives its share, and a fifth of a single row is none.
    assert S.train_test_split(df, "id", "label").filter("is_test").count() == 0


def test_vocabulary_bounds(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "cafe AU bar"), (3, None), (4, "au")], "id int, text string")
    got = {r["term"]: r["df"] for r in vocabulary(terms(docs, "id", "text"), max_df=1.0).collect()}
    assert got == {"cafe": 2, "au": 3, "cafe au": 2}


def tfidf_cases():
    rng = random.Random(7)
    common, rare = [f"w{i}" for i in range(60)], [f"r{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(common, [1 / (k + 1) for k in range(60)], k=80) + rng.choices(rare, k=40))) for i in range(200)]
    return rows + [(200, None), (201, ""), (202, "a b c"), (7, "w0 w1 w1"), (7, "w1 w0"), (203, "\ufb01nance ΟΔΟΣ, cafe\u0301 ½x \uac00\uac01 Ｗ0-w1"),
                   (204, "finance οδοσ caf\u00e9 x_1"), (205, "finance οδοσ cafe \uac00\uac01")]


def tfidf_brute(rows, max_features, max_df=0.95):
    found = []
    for _, text in rows:
        words = re.findall(r"\w{2,}", "".join(c.lower() for c in _plain(text or "")))
        found.append(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    cf, df = Counter(t for ts in found for t in ts), Counter(t for ts in found for t in set(ts))
    best = sorted((t for t in cf if 2 <= df[t] <= max_df * len(rows)), key=lambda t: (-cf[t], t.encode()))[:max_features]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in best}
    vocab = [(t, df[t], round(idf[t], 9), i) for i, t in enumerate(sorted(best, key=str.encode))]
    per_id: dict = {}
    for (i, _), ts in zip(rows, found, strict=True):
        per_id.setdefault(i, Counter()).update(t for t in ts if t in idf)
    weighted = []
    for i, tf in per_id.items():
        w = {t: (math.log(n) + 1) * idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weighted += [(i, t, round(x / norm, 9)) for t, x in w.items()]
    return vocab, sorted(weighted)


@pytest.mark.parametrize("max_features, cells", [(50, 1 << 20), (50, 1 << 10), (50, 120), (50, 7), (100_000, 1 << 20)])
def test_tfidf_against_brute_force(spark, max_features, cells):
    rows = tfidf_cases()
    docs = textfeatures.terms(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    vocab = textfeatures.vocabulary(docs, max_features=max_features, cells=cells)
    want, weighted = tfidf_brute(rows, max_features)
    assert sorted(((r.term, r.df, round(r.idf, 9), r.idx) for r in vocab.collect()), key=lambda r: r[-1]) == want
    got = textfeatures.weights(docs, vocab, "id").collect()
    assert sorted((r.id, r.term, round(r.weight, 9)) for r in got) == weighted


def test_few_terms_are_counted_as_text(spark, monkeypatch):
    rows, seen, counted = tfidf_cases(), [], textfeatures.counted

    def watched(docs, chosen):
        seen.append(counted(docs, chosen).count())
        return counted(docs, chosen)

    monkeypatch.setattr(textfeatures, "counted", watched)
    docs = textfeatures.terms(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert textfeatures.vocabulary(docs, max_features=50).count() == 50
    # More than ten thousand terms in all; a hundred cells hold the frequent ones.
    assert len(seen) == 1 and seen[0] < 200


def test_tfidf_of_no_documents(spark):
    docs = textfeatures.terms(spark.createDataFrame([], "id int, t string"), "id", "t")
    vocab = textfeatures.vocabulary(docs)
    assert vocab.count() == 0 and textfeatures.weights(docs, vocab, "id").count() == 0


def test_sources(spark, tmp_path):
    for kind, names in {"cat": ["1.png", "2.JPG"], "dog": ["3.bmp", "note.txt"]}.items():
        (tmp_path / "img" / kind).mkdir(parents=True)
        for n in names:
            (tmp_path / "img" / kind / n).write_bytes(b"x")
    got = sorted((r["class_name"], r["label"]) for r in I.scan_labelled_dir(spark, str(tmp_path / "img")).collect())
    assert got == [("cat", 0), ("cat", 0), ("dog", 1)]
    csv = tmp_path / "d.csv"
    csv.write_text("a,b,target\n1,2,0\n3,4,1\n")
    rows = I.scan_tabular(I.read_any(spark, str(csv)))
    assert rows.dtypes == [("a", "float"), ("b", "float"), ("target", "int")]
    text = spark.createDataFrame([(1, None, "neg"), (2, "good", "pos")], "id int, review string, sentiment string")
    assert [r["text"] for r in I.scan_text(text).collect()] == ["", "good"]
    assert I.export_path("data", "credit-risk-v1", 5) == "data/credit_risk_v1/retrain_5.csv"
    images = spark.createDataFrame([(1, [0.0, 255.0, 0.0, 51.0], 3)], "k int, v array<double>, y int")
    row = I.scan_image_arrays(images, "v", "y", "k").first()
    assert row["vector"] == [0.0, 1.0, 0.0, 0.2] and row["side"] == 2


def test_manifest_sees_replaced_duplicates(spark):
    old = spark.createDataFrame([("p", 1), ("p", 1), ("q", 5)], "part string, v int")
    new = spark.createDataFrame([("p", 2), ("p", 2), ("r", 5)], "part string, v int")
    changes = I.data_changes(I.manifest(old, F.col("part")), I.manifest(new, F.col("part"))).collect()
    assert {r["part"]: r["change"] for r in changes} == {"p": "changed", "q": "removed", "r": "added"}


def test_accents_as_the_character_database_says(spark):
    import unicodedata

    from driftwell.functions.text import _plain, strip_accents

    codes = [*range(0x20, 0x3000), *range(0xAC00, 0xAC40), *range(0xE000, 0xE003), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D440), *range(0x1F100, 0x1F200)]
    texts = [chr(c) for c in codes] + ["", None, "Ünïcödé ﬁn ½ ﷺ x", "plain ascii_9", "e\u0301a\u0323\u0307", "한글 é", "a" * 5000 + "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.p for r in df.select("id", strip_accents(F.col("t")).alias("p")).collect()}
    assert unicodedata.unidata_version
    wrong = [(texts[i], p) for i, p in got.items() if p != (None if texts[i] is None else _plain(texts[i]))]
    assert wrong == []


def test_profile_counts_distinct_values_without_expanding_rows(spark):
    from driftwell.operators import quality as Q

    rows = [(1, 0.0, "a", [1], b"x"), (2, -0.0, "A", [1], b"y"), (None, float("nan"), None, None, None), (2, 1.5, "a", [2, 1], b"x")]
    df = spark.createDataFrame(rows, "i int, d double, s string, l array<int>, b binary")
    profile = Q.column_profile(df)
    assert "Expand" not in profile._jdf.queryExecution().optimizedPlan().toString()
    assert {r.column: (r.non_null_count, r.unique_count) for r in profile.collect()} == {"i": (3, 2), "d": (3, 2), "s": (3, 2), "l": (3, 2), "b": (3, 2)}
    assert [r.unique_count for r in Q.column_profile(df.filter("false")).collect()] == [0] * 5


def test_custom_metrics_per_model(spark):
    from driftwell.operators.metrics import custom_metrics

    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 1.0, 1.0), ("b", 2.0, 5.0), ("c", 1.0, 3.0), ("c", None, 3.0)], "model_id string, ground_truth double, result double")
    measures = {"a": {"misses": lambda y, p: F.count_if(y != p)}, "*": {"bias": lambda y, p: F.avg(p - y), "worst": lambda y, p: F.max(F.abs(p - y))}}
    got = {(r.model_id, r.metric): (r.value, r.n) for r in custom_metrics(df, measures).collect()}
    assert got == {("a", "misses"): (1.0, 2), ("b", "bias"): (3.0, 1), ("b", "worst"): (3.0, 1), ("c", "bias"): (2.0, 1), ("c", "worst"): (2.0, 1)}
