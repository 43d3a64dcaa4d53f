"""Joins with a table that is usually small: one row per key, group or rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.session import ensure_checkpoints

SMALL_BYTES = 64 << 20


def scanned_bytes(df: DataFrame) -> int:
    """Sum of the planner's sizes of all scanned inputs (file sizes; no job runs)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(leaves.next().stats().sizeInBytes())
    return total


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own limit for broadcasts in bytes; -1 forbids them."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(said[-1:], 1)
    return int(said.rstrip("kmg")) * scale


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
               limit: int | None = None, plain_below: int = SMALL_BYTES) -> DataFrame:
    """Join a table that is usually small to a large one, null keys meeting null keys.

    The small side is written and measured first. Within the limit (the session's own by default) it is broadcast,
    so the large side is not shuffled; beyond, both are shuffled, and adaptive execution splits hot keys of the
    large side. Where all that the large side reads is known to be less than `plain_below` bytes, measuring would
    cost more than a shuffle of it can: then the small side is broadcast if all that it reads is within the limit,
    and else the join is left to the planner.
    """
    if limit is None and scanned_bytes(big) < plain_below:
        right = F.broadcast(small) if scanned_bytes(small) <= broadcast_limit(big.sparkSession) else small
    else:
        ensure_checkpoints(small.sparkSession)
        small = small.checkpoint()
        width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in small.columns), F.lit(16))
        held = small.select(F.coalesce(F.sum(width), F.lit(0))).first()[0]
        within = held <= (broadcast_limit(big.sparkSession) if limit is None else limit)
        right = F.broadcast(small) if within else small
    right = right.select(*(F.col(c).alias(f"__{c}") for c in small.columns))
    met = F.lit(True)
    for key in keys:
        met = met & big[key].eqNullSafe(right[f"__{key}"])
    joined = big.join(right, met, how)
    rest = [c for c in small.columns if c not in keys]
    return joined.select(*(big[c] for c in big.columns), *(F.col(f"__{c}").alias(c) for c in rest))
