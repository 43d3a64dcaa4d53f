"""What the operators of this folder share."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import smallside
from driftwell.session import ensure_checkpoints

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

BATCH = 7 << 17  # bytes of texts that go to a Python worker at once; a longer text goes alone


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name and position.

    Columns that differ in case only, or occur twice, do not disturb; of two equal names the first counts.
    """
    at = {name: df.columns.index(name) for name in names}
    apart = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return apart.select(*(F.col(f"c{i}").alias(name) for name, i in at.items()))


def kept_once(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there, so that nothing above runs again."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """The small side measured whatever the size of the other, so that plans are alike at every size."""
    return smallside.join_small(big, small, keys, how, plain_below=0)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of the key; 52 bits, the same in every engine that has md5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def uniform_sql(key: str, seed: int) -> str:
    return (f"((CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '') || ':{seed}'), 1, 13) AS BIGINT)::DOUBLE"
            f" + 0.5e0) / {1 << 52}.0e0)")


def batches_by_bytes(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes too: ten thousand texts, the default, have no bound in memory, neither in the JVM
    nor in the worker. A setting that the session has stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH))


def free_stores(keep: str | None = None) -> None:
    """Called as a task starts: the models and caches that other operators left in this Python worker go, and the memory
    that Arrow has kept. Workers outlive jobs, so the stages of a pipeline would pile up in them."""
    home = sys.modules.setdefault("driftwell_worker_store", types.ModuleType("driftwell_worker_store"))
    for name in [n for n in vars(home) if n != keep and not n.startswith("__")]:
        delattr(home, name)
    pa.default_memory_pool().release_unused()


def worker_store(name: str) -> dict:
    """A dict for models and caches that tasks of one worker share. It lives until the worker serves another operator."""
    free_stores(name)
    return vars(sys.modules["driftwell_worker_store"]).setdefault(name, {})
