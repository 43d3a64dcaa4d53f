"""A corpus pipeline: each stage works on all its predecessor kept, as Parquet written in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import exact_dedup, language, mixing, simhash, word_bpe
from driftwell.session import scratch_path

STAGES = [
    ("language ID", language.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("BPE encoding", word_bpe.stage),
]

# Code lengths, fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
