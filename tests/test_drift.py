import math

import numpy as np
import pytest

from driftwell.functions.exact_ks import exact_ks_p
from driftwell.operators import drift as D


def frame(spark, reference, current, model="m", feature="f"):
    rows = [(model, feature, float(v), True) for v in reference] + [(model, feature, float(v), False) for v in current]
    return spark.createDataFrame(rows, "model_id string, feature_name string, value double, is_reference boolean")


def normal(mean, std, n, seed):
    return np.random.default_rng(seed).normal(mean, std, n)


@pytest.mark.parametrize("chunks", [1, 3])
def test_ks(spark, chunks):
    same = D.ks(frame(spark, [1, 2, 3, 4, 5] * 10, [1, 2, 3, 4, 5] * 10), chunks=chunks).first()
    assert same["statistic"] == 0 and same["p_value"] == 1.0 and not same["drift_detected"]
    assert same["recommendation"] == "No action needed. Distribution remains stable."
    shifted = D.ks(frame(spark, normal(0, 1, 100, 1), normal(5, 1, 100, 2)), chunks=chunks).first()
    assert shifted["drift_detected"] and shifted["p_value"] < 0.05 and shifted["method"] == "ks_test"
    assert shifted["recommendation"].startswith("CRITICAL: Severe drift in f.")
    assert shifted["sample_size"] == 100


def test_exact_ks_p_counts_paths():
    assert exact_ks_p(1.0, 5, 5) == pytest.approx(2 / math.comb(10, 5))
    assert exact_ks_p(0.0, 5, 5) == 1.0
    # every split of {1,2,3} against one point reaches 1/3
    assert exact_ks_p(1 / 3, 3, 1) == pytest.approx(1.0)
    assert exact_ks_p(1.0, 3, 1) == pytest.approx(2 / 4)


def test_asymptotic_p_is_close_to_exact(spark):
    samples = frame(spark, normal(0, 1, 400, 3), normal(0.15, 1, 500, 4))
    exact = D.ks(samples).first()["p_value"]
    asymptotic = D.ks(samples).first()["p_value"]
    assert asymptotic == pytest.approx(exact, abs=0.01)


def test_ks_and_wasserstein_against_numpy(spark):
    a, b = normal(0, 1, 80, 5), np.round(normal(0.5, 2, 60, 6), 1)
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    samples = frame(spark, a, b)
    assert D.ks(samples, chunks=1).first()["statistic"] == pytest.approx(np.max(np.abs(fa - fb)))
    area = float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))
    for chunks in (1, 4):
        row = D.wasserstein(samples, chunks=chunks).first()
        assert row["statistic"] == pytest.approx(area)
        assert row["threshold"] == pytest.approx(np.std(a) * 0.5)
    swapped = D.wasserstein(frame(spark, b, a), chunks=1).first()
    assert swapped["statistic"] == pytest.approx(area)


def test_wasserstein_constant(spark):
    row = D.wasserstein(frame(spark, [1, 1, 1], [10, 10, 10]), chunks=1).first()
    assert row["statistic"] == 9.0 and row["drift_detected"]


def numpy_psi(reference, current):
    edges = np.unique(np.percentile(reference, np.linspace(0, 100, 11)))
    edges = np.array([-np.inf, np.inf]) if len(edges) < 2 else np.concatenate([[-np.inf], edges[1:-1], [np.inf]])
    r = np.clip(np.histogram(reference, bins=edges)[0] / len(reference), 1e-10, 1)
    c = np.clip(np.histogram(current, bins=edges)[0] / len(current), 1e-10, 1)
    return float(np.sum((c - r) * np.log(c / r)))


@pytest.mark.parametrize(
    "reference, current",
    [
        (normal(10, 2, 1000, 7), normal(10, 2, 1000, 8)),
        (normal(10, 2, 1000, 7), normal(15, 2, 1000, 9)),
        ([1, 1, 1, 1, 2, 2, 3], [0, 1, 2, 3, 3, 4]),
        ([1, 1, 1, 1, 1, 1, 1, 1, 1, 2], [0, 1, 1, 2, 3]),
        ([5] * 20, [1, 5, 9]),
        (list(range(11)), [-1, 0, 0.5, 10, 11]),
    ],
)
def test_psi_equals_the_histogram_definition(spark, reference, current):
    for chunks in (1, 3):
        row = D.psi(frame(spark, reference, current), chunks=chunks).first()
        assert row["statistic"] == pytest.approx(numpy_psi(reference, current), abs=1e-9)
    assert row["drift_detected"] == (row["statistic"] > 0.25)
    assert row["threshold"] == 0.25


def numpy_chi2(reference, current):
    edges = np.histogram_bin_edges(np.concatenate([reference, current]), bins=10)
    r = np.histogram(reference, bins=edges)[0] + 1.0
    c = np.histogram(current, bins=edges)[0] + 1.0
    expected = r / r.sum() * c.sum()
    return float(np.sum((c - expected) ** 2 / expected))


@pytest.mark.parametrize(
    "reference, current",
    [
        (normal(10, 2, 500, 1), normal(10, 2, 500, 2)),
        (normal(0, 1, 500, 3), normal(10, 1, 500, 4)),
        ([3.0] * 5, [3.0] * 9),
        (np.arange(0, 101) / 10, np.arange(0, 51) / 5),
    ],
)
def test_chi2_equals_the_histogram_definition(spark, reference, current):
    row = D.chi2(frame(spark, reference, current)).first()
    assert row["statistic"] == pytest.approx(numpy_chi2(reference, current), rel=1e-9, abs=1e-9)
    assert row["drift_detected"] == (row["p_value"] < 0.05)


def test_chi2_tail_values(spark):
    from pyspark.sql import functions as F

    from driftwell.functions.math import chi2_sf, erf, norm_cdf

    x = F.col("x")
    df = spark.createDataFrame([(16.918977604620448,)], "x double")  # 95 % point for 9 degrees
    assert df.select(chi2_sf(x, 9)).first()[0] == pytest.approx(0.05, abs=1e-12)
    df = spark.createDataFrame([(v,) for v in (-7.0, -1.3, 0.0, 0.4, 2.5, 5.9)], "x double")
    for value, e, n in df.select(x, erf(x), norm_cdf(x)).collect():
        assert e == pytest.approx(math.erf(value), abs=1e-14)
        assert n == pytest.approx(0.5 * (1 + math.erf(value / math.sqrt(2))), abs=1e-14)


def test_many_keys_hot_key_and_missing_sides(spark):
    hot = frame(spark, normal(0, 1, 500, 1), normal(2, 1, 500, 2), "hot")
    cold = frame(spark, [1, 2, 3], [1, 2, 3], "cold")
    gone = frame(spark, [1, 2], [], "gone")
    samples = hot.unionByName(cold).unionByName(gone)
    for method in D.METHODS:
        got = {r["model_id"]: r["drift_detected"] for r in D.drift(samples, method).collect()}
        assert got["hot"] is True and got["cold"] is False and "gone" not in got
    problems = D.sample_problems(samples, min_points=5).collect()
    assert {r["model_id"]: r["reason"] for r in problems} == {
        "gone": "Data samples cannot be empty", "cold": "Not enough data points (3) to calculate drift",
    }


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="Unsupported test type: 'nope'. Supported: chi2, ks, psi, wasserstein"):
        D.drift(frame(spark, [1], [1]), "nope")


def test_empty_vectors_and_nan_are_skipped(spark):
    from pyspark.sql import functions as F

    logs = spark.createDataFrame(
        [("m", [1.0, float("nan")], True), ("m", [], True), ("m", [2.0], False)],
        "model_id string, features array<double>, ref boolean",
    )
    rows = D.feature_samples(logs, F.col("ref"))
    assert rows.count() == 3
    assert [r["feature_name"] for r in D.ks(rows).collect()] == ["feature_0"]


def brute_p(reference, current, n, seed):
    rng = np.random.default_rng(seed)
    both = np.concatenate([reference, current])
    k = len(reference)

    def distance(order):
        values = np.sort(both)
        a, b = np.sort(both[order[:k]]), np.sort(both[order[k:]])
        gap = np.searchsorted(a, values[:-1], "right") / len(a) - np.searchsorted(b, values[:-1], "right") / len(b)
        return float(np.abs(gap) @ np.diff(values))

    seen = distance(np.arange(len(both)))
    return float(np.mean([distance(rng.permutation(len(both))) >= seen * (1 - 1e-12) for _ in range(n)]))


@pytest.mark.parametrize("chunks", [None, 5])
@pytest.mark.parametrize(
    "reference, current",
    [
        (normal(0, 1, 60, 1), normal(0.25, 1, 40, 2)),
        (normal(0, 1, 300, 3), normal(0.12, 1, 300, 4)),
        ([1, 1, 2, 3, 3, 3, 4, 5], [2, 3, 4, 4, 5, 5]),
        ([1.0, 2.0], [3.0, 4.0, 5.0]),
        (normal(0, 1, 50, 5), normal(5, 1, 50, 6)),
    ],
)
def test_relabelled_p_is_the_permutation_p(spark, reference, current, chunks):
    """Within four standard errors of both Monte-Carlo runs."""
    got = D.wasserstein(frame(spark, reference, current), relabelings=1000, chunks=chunks).first()
    want = brute_p(np.asarray(reference, float), np.asarray(current, float), 4000, 9)
    assert abs(got["p_value"] - want) <= 4 * math.sqrt(max(want * (1 - want), 0.001) * (1 / 1000 + 1 / 4000))
    plain = D.wasserstein(frame(spark, reference, current), chunks=chunks).first()
    assert plain["p_value"] is None and plain["statistic"] == pytest.approx(got["statistic"]) and plain["drift_detected"] == got["drift_detected"]


def test_relabelled_p_reruns_agree_and_skip_one_sided_keys(spark):
    hot, gone = frame(spark, normal(0, 1, 90, 1), normal(0.3, 1, 80, 2), "hot"), frame(spark, [1, 2], [], "gone")
    once, again = (sorted(map(tuple, D.wasserstein(hot.unionByName(gone), relabelings=50, chunks=4).collect())) for _ in range(2))
    assert once == again and [r[0] for r in once] == ["hot"] and 0 <= once[0][3] <= 1
