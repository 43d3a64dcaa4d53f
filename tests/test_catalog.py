"""Every registered query against its SQL, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

TRAINING = {"train_credit", "train_house", "train_fraud", "train_sentiment", "train_image", "train_challenger",
            "cv_scores", "hpo_cv"}


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tiny, duck, name):
    good, note = compare(spark, duck, name, tiny, queries()[name], oracle_sql()[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - TRAINING))
def test_query_without_sql_runs(spark, tiny, name):
    assert queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 9


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_rows_are_limited_before_the_shuffle(spark, tiny):
    text = plan(queries()["recent_logs"](spark, tiny))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_is_used(spark, tiny):
    text = plan(queries()["label_rate"](spark, tiny))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_no_query_pairs_all_rows(spark, tiny):
    skip = TRAINING | {n for n in queries() if n.startswith(("stream_", "sink_", "source_", "self_"))}
    for name in sorted(set(queries()) - skip):
        text = plan(queries()[name](spark, tiny))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
