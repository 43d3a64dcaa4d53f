"""What a Python worker holds while it serves one operator after the other."""

import pyarrow as pa
from driftwell.llm import language, word_bpe
from driftwell.llm.common import BATCH, worker_store
from pyspark.sql import functions as F
from tests.llm.helpers import frame


def test_a_worker_keeps_the_models_of_one_operator():
    worker_store("one")["model"] = [1]
    assert worker_store("one") == {"model": [1]}
    worker_store("two")["model"] = [2]
    assert worker_store("two") == {"model": [2]} and worker_store("one") == {}
    worker_store("word_bpe")["bpe"] = "large"
    list(language.gram_counter(language.folded())(iter([])))
    assert worker_store("word_bpe") == {}


def test_batches_end_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = frame(spark, [(i, f"{i} " + "word " * 1000) for i in range(2000)]).coalesce(1)

    @F.arrow_udf("long")
    def held(batch: pa.Array) -> pa.Array:
        return pa.array([batch.nbytes] * len(batch))

    word_bpe.encoded(docs, word_bpe.definition_of())
    sizes = [r.held for r in docs.select(held("text").alias("held")).distinct().collect()]
    assert max(sizes) <= BATCH + 10_000
    assert [r.n for r in docs.select(word_bpe.coded(spark, F.col("text"), word_bpe.definition_of()).alias("x")).groupBy("x.n_tokens").agg(F.count("*").alias("n")).collect()]


def test_a_setting_of_the_session_stands(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "4096")
    word_bpe.encoded(frame(spark, [(1, "x")]), word_bpe.definition_of())
    assert spark.conf.get(key) == "4096"
    spark.conf.unset(key)


def test_language_codes_need_no_workers_for_rows(spark, monkeypatch):
    given = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or make(self, data, *a, **b))
    docs = [(1, "the water and the house", "en"), (2, "das wasser und das haus", "de")]
    trees = language.learned(make(spark, docs, "doc_id long, text string, lang string").select("lang", "text"))
    assert trees.languages == ["de", "en"] and given == [pa.Table]
