"""Greedy spacing: keep an event only when enough time passed since the last kept one.

Alert cooldowns and prediction-cache expiry share this rule. Whether an event is
kept depends on the event kept before it, so it cannot be written as a window. The
scan here needs one number of state per key. Events are cut into chunks (see
`ordered`); every chunk is summarised as runs: "entered so that the first kept event
is at most `bound`, left with last = `exit`". Every run knows the run of a later chunk
that follows it, so runs are a forest, and what a key visits is the path from its first
run. Pointers are doubled until that path is found: as many joins as the path's length
has bits, each over equal shares of all runs, however many a single key holds. All
chunks then replay in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from driftwell.operators.ordered import CHUNK, carry_last, chunked, planned_chunks

KEY = "_key"
AT = "_at"
GAP = "_gap"
NEVER = np.iinfo(np.int64).min


def exit_table(at: np.ndarray, gap: int, strict: bool, start: int = NEVER) -> tuple[list[int], list[int]]:
    """Chunk summary as (upper bound of first kept event, last kept event) runs.

    Entering with last = x, the first kept event is the first one at or after
    x + gap (after it when strict). Only events within one gap of the chunk's first
    event can be that, so the table covers those, merged where the exit is equal. A
    chunk that begins before `start` is always entered with last = start: one run.
    """
    side = "right" if strict else "left"
    following = np.searchsorted(at, at + gap, side=side)
    size = len(at)
    last = at.copy()
    for i in range(size - 1, -1, -1):
        if following[i] < size:
            last[i] = last[following[i]]
    if start > at[0]:
        first = int(np.searchsorted(at, start + gap, side=side))
        return at[first : first + 1].tolist(), last[first : first + 1].tolist()
    reach = min(int(following[0]) + 1, size)
    bounds, exits = at[:reach], last[:reach]
    ends = np.append(np.flatnonzero(exits[1:] != exits[:-1]), reach - 1)
    return bounds[ends].tolist(), exits[ends].tolist()


def keep_spaced(at: np.ndarray, gap: int, strict: bool, last: int) -> tuple[list[int], int]:
    """Positions kept of sorted times, jumping from one kept event to the next."""
    side = "right" if strict else "left"
    kept = []
    i = 0 if last == NEVER else int(np.searchsorted(at, last + gap, side=side))
    while i < len(at):
        kept.append(i)
        last = int(at[i])
        i = max(i + 1, int(np.searchsorted(at, last + gap, side=side)))
    return kept, last


def _replay(strict: bool):
    """Walk sorted rows scan by scan, carrying one number across the batches of a scan."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, last = None, NEVER
        for batch in batches:
            keys, chunks = batch[KEY].to_numpy(), batch[CHUNK].to_numpy()
            at, gaps, entries = (batch[c].to_numpy() for c in (AT, GAP, "_entry"))
            kept = np.zeros(len(batch), dtype=bool)
            changes = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            edges = [0, *changes.tolist(), len(batch)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if (keys[low], chunks[low]) != scan:
                    scan, last = (keys[low], chunks[low]), int(entries[low])
                hits, last = keep_spaced(at[low:high], int(gaps[low]), strict, last)
                kept[np.asarray(hits, dtype=np.int64) + low] = True
            yield batch.assign(_kept=kept)

    return walk


def spaced(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: list[str],
    gap_seconds: float | Column,
    out: str = "kept",
    strict: bool = False,
    chunks: int | None = None,
    entries: DataFrame | None = None,
) -> DataFrame:
    """Flag the events kept by the greedy rule, per `keys` in order of (`at`, `tie`).

    The gap may be a column that is constant per key. `entries` (keys, last_kept)
    continues from an earlier run: one row per key.
    """
    seconds = gap_seconds if isinstance(gap_seconds, Column) else F.lit(float(gap_seconds))
    n = chunks or planned_chunks(df)
    columns = df.columns
    key = F.to_json(F.struct(*keys))
    never = F.lit(int(NEVER))
    base = df.withColumns(
        {
            KEY: key,
            AT: F.unix_micros(F.col(at).cast("timestamp")),
            GAP: F.round(seconds * 1_000_000).cast("bigint"),
        }
    )
    if entries is None:
        base = base.withColumn("_start", never)
    else:
        starts = entries.select(key.alias(KEY), F.unix_micros(F.col("last_kept").cast("timestamp")).alias("_start"))
        base = base.join(starts, KEY, "left").withColumn("_start", F.coalesce("_start", never))
    if n == 1:
        ready = base.withColumns({CHUNK: F.lit(0), "_entry": F.col("_start")}).repartition(KEY)
    else:
        part = chunked(base, [KEY], [AT, *tie], n)
        state = _entries(part, strict, n)
        joined = part.join(state, [KEY, CHUNK], "left").repartition(F.col(KEY), F.col(CHUNK))
        ready = joined.withColumn("_entry", F.coalesce("_entry", "_start"))
    flagged = ready.sortWithinPartitions(KEY, CHUNK, AT, *tie)
    schema = StructType([*ready.schema.fields, StructField("_kept", BooleanType())])
    return flagged.mapInPandas(_replay(strict), schema).select(
        *columns, F.col("_kept").alias(out)
    )


def _runs(wide: DataFrame, strict: bool) -> DataFrame:
    """(key, chunk, gap, bound, exit): the summary of every chunk, one row per run."""

    def summarise(rows: pa.Table) -> pa.Table:
        gap, start = rows[GAP][0].as_py(), rows["_start"][0].as_py()
        bounds, exits = exit_table(np.sort(rows[AT].to_numpy()), gap, strict, start)
        n = len(bounds)
        return pa.table(
            {
                KEY: pa.array([rows[KEY][0].as_py()] * n, pa.string()), CHUNK: pa.array([rows[CHUNK][0].as_py()] * n, pa.int32()),
                GAP: pa.array([gap] * n, pa.int64()), "bound": pa.array(bounds, pa.int64()), "exit": pa.array(exits, pa.int64()),
            }
        )

    return wide.groupBy(KEY, CHUNK).applyInArrow(summarise, f"{KEY} string, {CHUNK} int, {GAP} bigint, bound bigint, exit bigint")


def _followers(runs: DataFrame, starts: DataFrame, strict: bool, chunks: int) -> DataFrame:
    """(key, chunk, bound, to_chunk, to_bound): the run after every run, and after the start (chunk -1) of every key.

    It is the first run whose bound lies a gap after the exit. Runs and the times they ask for are put in one line,
    latest first, and the last run passed is carried along it.
    """
    here = F.struct(F.col(CHUNK).alias("c"), F.col("bound").alias("b"))
    place = F.col(CHUNK).alias("_place")
    asked = runs.select(KEY, place, "bound", (F.col("exit") + F.col(GAP)).alias("_t"))
    first = starts.select(
        KEY, F.lit(-1).alias("_place"), F.lit(0).cast("bigint").alias("bound"),
        F.when(F.col("_start") == NEVER, F.lit(1 - (1 << 63))).otherwise(F.col("_start") + F.col(GAP)).alias("_t"),
    )
    asks = asked.unionByName(first).withColumns({"_asks": F.lit(0 if strict else 1), "_run": F.lit(None).cast("struct<c:int,b:bigint>")})
    passed = runs.select(KEY, place, "bound", F.col("bound").alias("_t"), F.lit(1 if strict else 0).alias("_asks"), here.alias("_run"))
    line = asks.unionByName(passed).withColumns({"_back": -F.col("_t"), "_order": -F.col("_place"), "_is_run": F.col("_run").isNotNull()})
    carried = carry_last(line, [KEY], ["_back", "_asks", "_order", "bound"], ["_run"], chunks)
    return carried.filter("not _is_run and _run is not null").select(
        KEY, F.col("_place").alias(CHUNK), "bound", F.col("_run.c").alias("to_chunk"), F.col("_run.b").alias("to_bound"))


def _visited(steps: DataFrame) -> DataFrame:
    """(key, chunk, bound) of all runs on the way from the start of a key, by doubled pointers."""
    steps = steps.checkpoint()
    reached = steps.filter(F.col(CHUNK) < 0).select(KEY, F.col("to_chunk").alias(CHUNK), F.col("to_bound").alias("bound")).checkpoint()
    jumps = steps.filter(F.col(CHUNK) >= 0)
    while True:
        further = reached.join(jumps, [KEY, CHUNK, "bound"]).select(
            KEY, F.col("to_chunk").alias(CHUNK), F.col("to_bound").alias("bound")).checkpoint()
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further).distinct().checkpoint()
        ends = jumps.select(KEY, F.col(CHUNK).alias("to_chunk"), F.col("bound").alias("to_bound"),
                            F.col("to_chunk").alias("_chunk_after"), F.col("to_bound").alias("_bound_after"))
        jumps = jumps.join(ends, [KEY, "to_chunk", "to_bound"]).select(
            KEY, CHUNK, "bound", F.col("_chunk_after").alias("to_chunk"), F.col("_bound_after").alias("to_bound")).checkpoint()


def _entries(part: DataFrame, strict: bool, chunks: int) -> DataFrame:
    """Last kept event before each (key, chunk)."""
    # A key that lives in one chunk needs no entry state; the rest are few: a
    # chunk holds at most one key that began before it and one that ends after it.
    # Without a gap every event is kept, whatever came before.
    spans = part.groupBy(KEY).agg(F.countDistinct(CHUNK).alias("_spans")).filter("_spans > 1")
    spaced_apart = F.col(GAP) >= 0 if strict else F.col(GAP) > 0
    wide = part.select(KEY, CHUNK, AT, GAP, "_start").filter(spaced_apart).join(spans, KEY, "left_semi").checkpoint()
    places = wide.select(KEY, CHUNK, GAP, "_start").distinct().checkpoint()
    runs = _runs(wide, strict).checkpoint()
    starts = places.groupBy(KEY).agg(F.first(GAP).alias(GAP), F.first("_start").alias("_start"))
    way = _visited(_followers(runs, starts, strict, chunks))
    exits = way.join(runs.select(KEY, CHUNK, "bound", "exit"), [KEY, CHUNK, "bound"]).select(KEY, CHUNK, "exit")
    # One row per chunk of a key, and a chunk is many events.
    before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    entry = F.coalesce(F.last("exit", ignorenulls=True).over(before), F.col("_start"))
    return places.join(exits, [KEY, CHUNK], "left").select(KEY, CHUNK, entry.alias("_entry"))
