import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwell.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector):
    return [min(max(math.floor(256 * np.float64(np.float32(x))), H.LEAST), H.MOST) for x in vector]


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    good = [(i, whole(v), k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, k in good:
        if i % every == 0:
            bare = list(v)
            while bare and bare[-1] == 0:
                bare.pop()
            anchors[(i, k, tuple(bare))] = (i, v, k)
    out = []
    for i, v, k in anchors.values():
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), H.LEAST), H.MOST), j, m) for j, w, m in good if j != i]
        near = sorted((s, j) for s, j, m in scored if m == k)[:positives]
        for s, j in near:
            fits = sorted((t, n) for t, n, m in scored if m != k and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits)]
    return sorted(out)


def cases(seed, n=400, dims=8, labels=3, centres=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    if centres:
        v = rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + 0.05 * v
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, [float(x) for x in row], int(rng.integers(0, labels))) for i, row in enumerate(v)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("seed", "centres", "every", "tree"), [(1, 0, 50, 4096), (2, 12, 5, 4096), (3, 12, 3, 16), (4, 0, 2, 40)])
def test_against_brute_force(spark, seed, centres, every, tree):
    rows = cases(seed, centres=centres)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(H.hard_negatives(df, every=every, tree=tree)) == brute(rows, every)


def test_several_passes_give_the_same(spark):
    rows = cases(5, centres=6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(H.hard_negatives(df, every=4, tree=10, held=1, low=20, high=99, positives=2, negatives=7)) == brute(rows, 4, 2, 7, 20, 99)


def test_nulls_odd_values_ties_and_repeated_rows(spark):
    rng = random.Random(6)
    pool = [[1.0, 0.0], [0.5, 0.5], [0.25, 0.75], [0.5], [], [0.0, 0.0, 1.0], [-1.0, -0.2], None, [None, 1.0], [float("nan"), 0.1], [float("inf")]]
    rows = [(rng.choice([None, *range(0, 60)]), rng.choice(pool), rng.choice([None, 0, 1])) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(H.hard_negatives(df, every=10)) == brute(rows, 10)


def test_values_beyond_doubles_and_64_bits(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([1e30, -1e30, 3e7, 1e12, 0.1, -5e9]) for _ in range(3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(H.hard_negatives(df, every=10)) == brute(rows, 10)


def test_a_third_of_all_rows_equal(spark):
    rows = cases(8, n=600, centres=5)
    rows += [(600 + i, rows[0][1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(H.hard_negatives(df, every=20)) == brute(rows, 20)


def test_empty_table_and_clashing_names(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(50, [1.0], 0), (None, None, None)], SCHEMA)).count() == 0
    rows = cases(9, n=120)
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("tree", "place", "vector", "k", "rank", "LABEL2")})
    assert rows_of(H.hard_negatives(odd)) == brute(rows)


def test_spanning_tree_is_least():
    rng = np.random.default_rng(10)
    points = rng.normal(size=(60, 3))
    order, parent, edge = H.spanning_tree(points)
    assert sorted(order) == list(range(60)) and parent[0] == -1 and all(0 <= p < i for i, p in enumerate(parent) if i)
    apart = np.linalg.norm(points[:, None] - points[None], axis=2)
    pairs = sorted((apart[i, j], i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for length, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += length
    assert edge.sum() == pytest.approx(total)


def test_bounds_pass_over_most_candidates():
    """Close anchors: the children's windows rule out most candidates without a score."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 32))
    anchors = np.floor(100 * (centres[rng.integers(0, 6, 200)] + 0.02 * rng.normal(size=(200, 32))))
    order, parent, edge = H.spanning_tree(anchors)
    table = pa.table({"tree": [0] * 200, "place": range(200), "parent": parent, "edge": edge, "vec_id": order, "label": [0] * 200, "vector": list(anchors[order])})
    tree = H.Tree(table, 32)
    vectors = np.floor(100 * rng.normal(size=(500, 32)))
    scores = tree.vectors @ vectors.T
    least, most = np.quantile(scores, 0.98, axis=1).astype(np.int64), np.full(200, H.MOST)
    a, y, score, scored = tree.met(np.ones(500, np.int64), vectors, False, least, most)
    want = {(i, j): int(scores[i, j]) for i, j in zip(*np.nonzero(scores >= least[:, None]))}
    assert {(i, j): s for i, j, s in zip(a.tolist(), y.tolist(), score.tolist())} == want
    assert scored < 0.35 * scores.size


def test_query_moves_labels(spark, tiny):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    out = H.op12_hard_negatives(spark, tiny)
    assert rows_of(out) == brute(rows)
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
