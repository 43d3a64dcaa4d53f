"""P-value of the Wasserstein distance by relabelling all rows, without shuffling them a thousand times.

Only the sorted distinct values and how many rows hold each matter. A relabelling gives n_ref of all rows to the
reference at random, so the numbers of reference rows per value follow the multivariate hypergeometric law. It is drawn
in two steps: first per chunk of sorted values (one row per key and chunk), then within each chunk, on its own. What a
chunk adds to the area between the two relabelled distributions needs nothing but the reference rows dealt to the
chunks before it. So one pass over the sorted values gives all relabelled distances, each following exactly the law
of a random permutation of all rows. Draws depend on seed, key and chunk number only: a task that runs again draws
the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.ordered import CHUNK, chunked, planned_chunks
from driftwell.session import ensure_checkpoints

KEY = "_key"
SEED = 42
SLACK = 1e-12  # distances that differ by rounding only are equal


def _generator(seed: int, key: str, *more: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(key.encode()), *more])))


def _dealt(rng: np.random.Generator, sizes: np.ndarray, taken: int) -> np.ndarray:
    """How many of `taken` rows each of the groups gets."""
    out = np.zeros(len(sizes), np.int64)
    if taken:
        rest = int(sizes.sum())
        for i, size in enumerate(sizes.tolist()):
            rest -= size
            out[i] = rng.hypergeometric(size, rest, taken) if size + rest < 10**9 else _wide(rng, size, rest, taken)
            taken -= int(out[i])
            if not taken:
                break
    return out


def _wide(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """A hypergeometric draw for totals beyond the generator's range, by its normal limit."""
    total = good + bad
    mean = taken * good / total
    spread = (mean * (bad / total) * ((total - taken) / max(1, total - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), taken - bad, 0), good, taken))


def _areas(values: np.ndarray, counts: np.ndarray, real: np.ndarray, following: float | None, before: np.ndarray,
           own: np.ndarray, size_before: int, n_ref: int, n_cur: int, rng: np.random.Generator) -> np.ndarray:
    """Area within a chunk for the real labels (first) and each relabelling; before and own count reference rows."""
    widths = np.diff(np.append(values, values[-1] if following is None else following))
    passed = size_before + np.cumsum(counts)

    def area(ref: np.ndarray, ahead: int) -> float:
        below = ahead + np.cumsum(ref)
        return float(np.abs(below / n_ref - (passed - below) / n_cur) @ widths)

    out = np.empty(len(own))
    out[0] = area(real, int(before[0]))
    for r in range(1, len(own)):
        taken, size = int(own[r]), int(counts.sum())
        if (counts == 1).all():
            ref = np.zeros(size, np.int64)
            ref[rng.permutation(size)[:taken]] = 1
        elif size < 10**9:
            ref = rng.multivariate_hypergeometric(counts, taken, method="marginals")
        else:
            ref = _dealt(rng, counts, taken)
        out[r] = area(ref, int(before[r]))
    return out


def relabelled_p(samples: DataFrame, keys: list[str], relabelings: int, seed: int = SEED, chunks: int | None = None) -> DataFrame:
    """(keys, p_value): the share of relabelings whose distance is at least the observed one, over all rows.

    samples: keys, value, is_reference; null and NaN values are left out, and keys with one side only give no row.
    """
    n = chunks or planned_chunks(samples)
    ensure_checkpoints(samples.sparkSession)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = samples.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        key.alias(KEY), (F.col("value") + 0.0).alias("value"), F.col("is_reference").cast("bigint").alias("n_ref"))
    distinct = rows.groupBy(KEY, "value").agg(F.sum("n_ref").alias("n_ref"), F.count("*").alias("n"))
    part = distinct.withColumn(CHUNK, F.lit(0)).checkpoint() if n == 1 else chunked(distinct, [KEY], ["value"], n)
    totals = part.groupBy(KEY, CHUNK).agg(F.sum("n").alias("size"), F.sum("n_ref").alias("ref"), F.min("value").alias("first"))

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        sizes, refs = table["size"].to_numpy(), table["ref"].to_numpy()
        n_ref, name = int(refs.sum()), table[KEY][0].as_py()
        n_cur = int(sizes.sum()) - n_ref
        if not n_ref or not n_cur:
            table, sizes, refs = table.slice(0, 0), sizes[:0], refs[:0]
        rng = _generator(seed, name)
        own = np.column_stack([refs, *(_dealt(rng, sizes, n_ref) for _ in range(relabelings))]) if len(sizes) else np.zeros((0, relabelings + 1), np.int64)
        before = np.cumsum(own, axis=0) - own
        many = pa.list_(pa.int64())
        return pa.table({
            KEY: table[KEY], CHUNK: table[CHUNK], "following": pa.array([*table["first"].to_pylist()[1:], None][:len(sizes)], pa.float64()),
            "own": pa.array(list(own), many), "before": pa.array(list(before), many), "size_before": pa.array(np.cumsum(sizes) - sizes, pa.int64()),
            "all_ref": pa.array([n_ref] * len(sizes), pa.int64()), "all_cur": pa.array([n_cur] * len(sizes), pa.int64()),
        })

    plan = totals.groupBy(KEY).applyInArrow(
        deal, f"{KEY} string, {CHUNK} int, following double, own array<bigint>, before array<bigint>, size_before bigint, all_ref bigint, all_cur bigint").checkpoint()

    def walk(values: pa.Table, plan: pa.Table) -> pa.Table:
        found = []
        if plan.num_rows and values.num_rows:
            values, (row,) = values.sort_by("value"), plan.to_pylist()
            rng = _generator(seed, row[KEY], 1, row[CHUNK])
            found = _areas(*(values[c].to_numpy() for c in ("value", "n", "n_ref")), row["following"], np.array(row["before"]),
                           np.array(row["own"]), row["size_before"], row["all_ref"], row["all_cur"], rng)
        return pa.table({KEY: pa.array([row[KEY]] * len(found) if len(found) else [], pa.string()), "r": pa.array(range(len(found)), pa.int32()),
                         "area": pa.array(found, pa.float64())})

    areas = part.groupBy(KEY, CHUNK).cogroup(plan.groupBy(KEY, CHUNK)).applyInArrow(walk, f"{KEY} string, r int, area double")
    distances = areas.groupBy(KEY, "r").agg(F.sum("area").alias("distance"))
    # A key has one row per relabelling here.
    packed = distances.groupBy(KEY).agg(
        F.max(F.when(F.col("r") == 0, F.col("distance"))).alias("observed"), F.collect_list(F.when(F.col("r") > 0, F.col("distance"))).alias("drawn"))
    reach = F.size(F.filter("drawn", lambda x: x >= F.col("observed") * (1 - SLACK)))
    names = samples.select(*keys).distinct().withColumn(KEY, key)
    return names.join(packed, KEY).select(*keys, (reach / F.lit(float(relabelings))).alias("p_value"))
