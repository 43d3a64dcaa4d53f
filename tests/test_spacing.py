import random

import pytest

from driftwell.operators.spacing import spaced


def brute(events, gap, strict, start=None):
    """events: sorted (t, id); returns the kept ids."""
    last, kept = start, []
    for t, i in events:
        if last is None or (t - last > gap if strict else t - last >= gap):
            kept.append(i)
            last = t
    return kept


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 2, 5, 40])
        rows.append(("noisy" if rng.random() < 0.8 else "calm", t, i))
    frame = spark.createDataFrame(rows, "k string, s long, id int").selectExpr("k", "timestamp_seconds(s) AS t", "id")
    return rows, frame


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("gap", [1, 10, 300, 100000])
@pytest.mark.parametrize("chunks", [1, 6])
def test_matches_a_sequential_walk(events, strict, gap, chunks):
    rows, frame = events
    got = {r["id"] for r in spaced(frame, ["k"], "t", ["id"], gap, "kept", strict, chunks).filter("kept").collect()}
    want = set()
    for key in ("noisy", "calm"):
        want |= set(brute(sorted((t, i) for k, t, i in rows if k == key), gap, strict))
    assert got == want


@pytest.mark.parametrize("chunks", [1, 5])
def test_continues_from_an_earlier_run(spark, events, chunks):
    rows, frame = events
    entries = spark.createDataFrame([("noisy", 50)], "k string, s long").selectExpr(
        "k", "timestamp_seconds(s) AS last_kept"
    )
    got = spaced(frame, ["k"], "t", ["id"], 100, "kept", chunks=chunks, entries=entries).filter("kept AND k = 'noisy'")
    want = brute(sorted((t, i) for k, t, i in rows if k == "noisy"), 100, False, 50)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def dense(n):
    """One key: bursts of many events inside one gap, then a few far apart."""
    rng, rows, t = random.Random(7), [], 0
    for burst in range(6):
        t += 5_000_000
        rows += [("hot", t + rng.randrange(900_000)) for _ in range(n)]
        rows += [("hot", t + 1_500_000 + 400_000 * i) for i in range(4)]
    rows += [("other", rng.randrange(40_000_000)) for _ in range(50)]
    return [(k, t, i) for i, (k, t) in enumerate(rows)]


@pytest.mark.parametrize(("gap", "strict"), [(0, False), (0, True), (0.3, True), (1, False), (30, True), (5000, False)])
def test_one_key_with_many_events_inside_a_gap(spark, gap, strict):
    rows = dense(1500)
    frame = spark.createDataFrame(rows, "k string, u long, id int").selectExpr("k", "timestamp_micros(u) AS t", "id")
    entries = spark.createDataFrame([("hot", 7_000_000)], "k string, u long").selectExpr("k", "timestamp_micros(u) AS last_kept")
    for start in (None, entries):
        got = {r["id"] for r in spaced(frame, ["k"], "t", ["id"], gap, "kept", strict, 24, start).filter("kept").collect()}
        want = set()
        for key in ("hot", "other"):
            after = 7_000_000 if start is not None and key == "hot" else None
            want |= set(brute(sorted((t, i) for k, t, i in rows if k == key), round(gap * 1_000_000), strict, after))
        assert got == want


def test_a_million_events_inside_one_gap_are_spread(spark):
    """No task gets more than its share of one key's runs: neither a chunk's summary nor the line that follows runs."""
    from pyspark.sql import functions as F

    from driftwell.operators import spacing as S
    from driftwell.operators.ordered import chunked

    events = spark.range(1_000_000).select(F.lit("hot").alias(S.KEY), F.col("id").alias(S.AT), F.lit(2_000_000).cast("bigint").alias(S.GAP),
                                           F.lit(S.NEVER).cast("bigint").alias("_start"))
    part = chunked(events, [S.KEY], [S.AT], 16)
    runs = S._runs(part, False).checkpoint()
    held = [r.n for r in runs.groupBy(S.CHUNK).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 1_000_000 and max(held) < 3 * 1_000_000 / 16
    frame = events.select(F.col(S.KEY).alias("k"), F.timestamp_micros(S.AT).alias("t"), F.col(S.AT).alias("id"))
    kept = spaced(frame, ["k"], "t", ["id"], 2, chunks=16).filter("kept")
    assert [r.id for r in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
