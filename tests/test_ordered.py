import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot key with half of the rows, repeated values, and a key of one row."""
    rng = np.random.default_rng(7)
    rows = [("hot", float(v), i) for i, v in enumerate(rng.integers(0, 60, 300))]
    rows += [("cold", float(v), 1000 + i) for i, v in enumerate(rng.normal(size=150))]
    rows += [("one", 3.0, 5000)]
    return spark.createDataFrame(rows, "k string, v double, id int")


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunks", [2, 7])
def test_chunked_scans_equal_plain_windows(skewed, chunks):
    counted = skewed.withColumns({"a": (F.col("id") % 2).cast("bigint"), "b": F.lit(1).cast("bigint")})
    plain = O.ecdf(counted, ["k"], "v", ["a", "b"], 1)
    cut = O.ecdf(counted, ["k"], "v", ["a", "b"], chunks)
    assert rows(plain) == rows(cut)
    assert rows(O.numbered(skewed, ["k"], ["v", "id"], chunks=1)) == rows(
        O.numbered(skewed, ["k"], ["v", "id"], chunks=chunks)
    )
    sums = {"s": "id"}
    assert rows(O.running_sums(skewed, ["k"], ["v", "id"], sums, 1)) == rows(
        O.running_sums(skewed, ["k"], ["v", "id"], sums, chunks)
    )


@pytest.mark.parametrize("chunks", [1, 5])
def test_percentiles_match_numpy(skewed, chunks):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["k"]: [r[n] for n in probs] for r in O.percentiles(skewed, ["k"], "v", probs, chunks).collect()}
    data = {}
    for k, v, _ in skewed.collect():
        data.setdefault(k, []).append(v)
    for k, values in data.items():
        assert got[k] == pytest.approx(list(np.percentile(values, [0, 25, 50, 99, 100])), abs=1e-12)


@pytest.mark.parametrize("most", [1 << 20, 400])
def test_bracketed_percentiles(spark, most):
    """Heavy ties, several keys, null keys and values; with `most` small, brackets are cut down again."""
    rng = np.random.default_rng(2)
    data = [("even", float(v)) for v in rng.normal(size=6000)] + [("ties", float(v)) for v in rng.integers(0, 3, 5000)]
    data += [("ties", 1e9)] * 3000 + [(None, 5.0), (None, 7.0), ("none", None), ("none", float("nan")), ("few", -0.0), ("few", 2.0), ("few", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"a": 0.0, "b": 0.001, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    want = O.percentiles(df, ["k"], "v", probs, 1)
    got = O.percentiles(df, ["k"], "v", probs, 4, 20 if most == 400 else 10_000, most)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: str(r.k)) == sorted(want.collect(), key=lambda r: str(r.k))
    assert O.percentiles(df, [], "v", probs, 4, 20, most).collect() == O.percentiles(df, [], "v", probs, 1).collect()


def test_percentiles_do_not_sort_the_column(skewed, monkeypatch):
    """No range copy: nothing but brackets is written."""
    monkeypatch.setattr(O, "chunked", None)
    O.percentiles(skewed, ["k"], "v", {"m": 0.5}, 4).collect()
    assert O.percentiles(skewed.filter("false"), [], "v", {"m": 0.5}, 4).collect()[0]["m"] is None
    assert O.percentiles(skewed.filter("false"), ["k"], "v", {"m": 0.5}, 4).count() == 0


@pytest.mark.parametrize("chunks", [1, 4])
def test_column_percentiles(spark, chunks):
    df = spark.createDataFrame([(1.0, 10), (2.0, None), (None, 30), (4.0, 20)], "a double, b int")
    got = {r["column"]: r["m"] for r in O.column_percentiles(df, ["a", "b"], {"m": 0.5}, chunks).collect()}
    assert got == {"a": 2.0, "b": 20.0}


@pytest.mark.parametrize("chunks", [2, 6])
def test_carry_last_crosses_chunks(spark, chunks):
    rng = np.random.default_rng(3)
    data = [("x" if i % 3 else "y", i, int(i) if rng.random() < 0.1 else None) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    assert rows(O.carry_last(df, ["k"], ["t"], ["v"], 1)) == rows(O.carry_last(df, ["k"], ["t"], ["v"], chunks))


@pytest.mark.parametrize("salts", [1, 4])
def test_top_per_key(skewed, salts):
    got = O.top_per_key(skewed, ["k"], [F.col("v").desc(), F.col("id")], 20, "id", "position", salts)
    data = {}
    for k, v, i in skewed.collect():
        data.setdefault(k, []).append((-v, i))
    want = {(k, i, p) for k, rows_ in data.items() for p, (_, i) in enumerate(sorted(rows_)[:20], start=1)}
    assert {(r["k"], r["id"], r["position"]) for r in got.collect()} == want


def test_small_files_need_no_chunks_and_unknown_sizes_do(spark, tiny):
    assert O.planned_chunks(spark.read.parquet(f"{tiny}/events.parquet")) == 1
    assert O.planned_chunks(spark.createDataFrame([(1,)], "a int")) > 1


def test_percentiles_leave_out_null_and_nan_on_both_sides(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", None), ("b", None), ("b", float("nan")), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = [sorted(map(str, O.percentiles(df, ["k"], "v", {"m": 0.5}, chunks=n).collect())) for n in (1, 4)]
    assert found[0] == found[1] == sorted(["Row(k='a', m=1.5)", "Row(k='b', m=None)", "Row(k=None, m=4.0)"])
    wide = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "x double, y double")
    found = [sorted(map(str, O.column_percentiles(wide, ["x", "y"], {"m": 0.5}, chunks=n).collect())) for n in (1, 4)]
    assert found[0] == found[1] == sorted(["Row(column='x', m=2.0)", "Row(column='y', m=None)"])
