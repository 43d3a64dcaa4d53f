from pyspark.sql import functions as F

from driftwell.operators import drift as D
from driftwell.operators.smallside import join_small


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_within_the_limit_and_joined_beyond(spark):
    big = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    small = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    want = [("a", 1, 10), ("c", 3, None), (None, 2, 20)]
    for limit, shape in ((1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        out = join_small(big, small, ["k"], limit=limit)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        if limit:
            assert shape in plan(out)


def test_psi_ships_counts_not_samples(spark):
    n = 4000
    samples = spark.range(n).select(
        F.concat(F.lit("m"), F.col("id") % 3).alias("model_id"), F.concat(F.lit("f"), F.col("id") % 5).alias("feature_name"), (F.col("id") % 977).cast("double").alias("value"),
        (F.col("id") % 2 == 0).alias("is_reference"))
    assert D.psi(samples).count() == 15
    assert "BroadcastHashJoin" in plan(D.psi(samples))
