"""Ordered scans that do not put one key into one task.

Running sums, ranks, exact percentiles and carry-forward all need rows in order
within a key, and a plain window puts a whole key into one task. Here a frame is
cut into *chunks*: ranges of (key, order) of equal size, whatever the skew, taken
from a range partitioning and made permanent by a reliable checkpoint. Each chunk
is scanned on its own; a table with one row per (key, chunk) carries the state from
chunk to chunk.

Inputs whose files are provably small (see `planned_chunks`) skip the chunks and
use one window per key: same result, fewer stages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.smallside import SMALL_BYTES, join_small, scanned_bytes
from driftwell.session import ensure_checkpoints

CHUNK = "_chunk"
CHUNK_BYTES = 32 << 20
MAX_CHUNKS = 100_000
MAX_SALTS = 256
SKETCH = 10_000  # a sketch's ranks are right to a ten-thousandth of the rows
SORTED = 1 << 20  # distinct values of one key that one task may sort
_UNKNOWN_BYTES = 1 << 60


def planned_chunks(df: DataFrame) -> int:
    """1 when the whole input is small enough for one task, else the number of chunks."""
    size = scanned_bytes(df)
    if size <= SMALL_BYTES:
        return 1
    parallel = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if size >= _UNKNOWN_BYTES:
        return parallel
    return max(parallel, min(MAX_CHUNKS, math.ceil(size / CHUNK_BYTES)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small input that arrives as one piece.

    For work that is heavy per row. Inputs of more than one chunk per core are left as
    they were read: shuffling them would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scanned_bytes(df) > cores * CHUNK_BYTES:
        return df
    return df.repartition(cores, F.col(key))


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """Add a chunk number that rises with (keys, order) and cannot change on recomputation."""
    ensure_checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(chunks, *[F.col(c) for c in [*keys, *order]])
    return ranged.withColumn(CHUNK, F.spark_partition_id()).checkpoint()


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _join_chunks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-chunk state back; keys compare null-safe."""
    on = [*keys, CHUNK]
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                           *[c for c in right.columns if c not in on])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition, "left").drop(*[f"_r_{c}" for c in on])


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], chunks: int | None = None
) -> DataFrame:
    """Inclusive running sums `{output: input}` per key in `order`."""
    n = chunks or planned_chunks(df)
    if n == 1:
        return df.withColumns({out: F.sum(src).over(_within(keys, order)) for out, src in sums.items()})
    part = chunked(df, keys, order, n)
    totals = part.groupBy(*keys, CHUNK).agg(*[F.sum(s).alias(f"_t_{o}") for o, s in sums.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    inner = part.withColumns(
        {out: F.sum(src).over(_within([*keys, CHUNK], order)) for out, src in sums.items()}
    )
    joined = _join_chunks(inner, offsets, keys)
    return joined.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums}).drop(
        CHUNK, *[f"_o_{o}" for o in sums]
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], out: str = "row_no", chunks: int | None = None
) -> DataFrame:
    """Exact row number per key."""
    return running_sums(df.withColumn("_one", F.lit(1)), keys, order, {out: "_one"}, chunks).drop("_one")


def ecdf(
    df: DataFrame, keys: list[str], value: str, counts: list[str], chunks: int | None = None
) -> DataFrame:
    """Collapse to distinct values and accumulate `counts` over them.

    Output per (keys, value): the counts, `cum_<count>` (inclusive), `tot_<count>`
    and `next_value`. Null and NaN values are dropped first. The collapse combines
    on the map side, so repeated values never travel twice per map task.
    """
    n = chunks or planned_chunks(df)
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    distinct = present.groupBy(*keys, value).agg(*[F.sum(c).alias(c) for c in counts])
    if n == 1:
        whole = Window.partitionBy(*keys)
        return distinct.select(
            *keys, value, *counts,
            *[F.sum(c).over(_within(keys, [value])).alias(f"cum_{c}") for c in counts],
            *[F.sum(c).over(whole).alias(f"tot_{c}") for c in counts],
            F.lead(value).over(whole.orderBy(value)).alias("next_value"),
        )
    part = chunked(distinct, keys, [value], n)
    totals = part.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{c}") for c in counts], F.min(value).alias("_first")
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    state = totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts],
        *[F.sum(f"_t_{c}").over(Window.partitionBy(*keys)).alias(f"tot_{c}") for c in counts],
        F.lead("_first").over(by_chunk).alias("_next_first"),
    )
    inner = part.withColumns(
        {
            **{f"cum_{c}": F.sum(c).over(_within([*keys, CHUNK], [value])) for c in counts},
            "_lead": F.lead(value).over(Window.partitionBy(*keys, CHUNK).orderBy(value)),
        }
    )
    return _join_chunks(inner, state, keys).select(
        *keys, value, *counts,
        *[(F.col(f"cum_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in counts],
        *[f"tot_{c}" for c in counts],
        F.coalesce("_lead", "_next_first").alias("next_value"),
    )


def ecdf_percentiles(frame: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles from an ecdf frame, one column per `{name: probability}`.

    Two ranks surround each percentile. Rows that hold none of them are filtered out
    first, which leaves at most two rows per percentile and key to aggregate.
    """
    position = {name: f"({float(p)!r}D * (tot_{count} - 1))" for name, p in probs.items()}

    def holds(rank: str) -> str:
        return f"(cum_{count} > {rank} AND cum_{count} - {count} <= {rank})"

    low = {name: holds(f"floor({x})") for name, x in position.items()}
    high = {name: holds(f"ceil({x})") for name, x in position.items()}
    rows = frame.filter(" OR ".join([*low.values(), *high.values()]))
    picks = rows.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN {hit} THEN `{value}` END) AS _lo_{n}") for n, hit in low.items()],
        *[F.expr(f"max(CASE WHEN {hit} THEN `{value}` END) AS _hi_{n}") for n, hit in high.items()],
        *[F.expr(f"max({x} - floor({x})) AS _at_{n}") for n, x in position.items()],
    )
    return picks.select(*keys, *[F.expr(f"_lo_{n} + (_hi_{n} - _lo_{n}) * _at_{n} AS `{n}`") for n in probs])


def _number(value) -> Column:
    """The value, or null for NaN."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(column.cast("double")), column)


def _between(values: Column, low: Column, high: Column) -> Column:
    return (values >= low) & (values <= high)


def _bracketed(rows: DataFrame, probs: list[float], sketch: int, most: int) -> DataFrame:
    """(_k, _p, _low, _high): for every key and probability the two values around its rank.

    rows: _k, _v (a double that is not null). A sketch gives bounds around every rank; one pass counts what lies below
    them and what lies between. The counts are exact, so they prove whether the ranks are there; bounds that missed
    (a sketch only promises) are widened to all values. What lies between, a few ten-thousandths of the rows and one
    per distinct value, is cut into ever fewer by its own quantiles until a key's share fits one task.
    """
    slack = 2.0 / sketch
    at = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    held = rows.groupBy("_k").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", at, sketch).alias("_q")).checkpoint()

    def ranks(p: float) -> tuple[Column, Column]:
        position = F.lit(float(p)) * (F.col("_n") - 1)
        return F.floor(position), F.ceil(position)

    bounds = F.array(*[
        F.struct(F.lit(j).alias("_p"), *(r.alias(f"_{side}_rank") for r, side in zip(ranks(p), ("low", "high"))),
                 (F.when(F.lit(p <= slack), F.col("_min")).otherwise(F.get("_q", F.lit(2 * j)))).alias("_from"),
                 (F.when(F.lit(p >= 1 - slack), F.col("_max")).otherwise(F.get("_q", F.lit(2 * j + 1)))).alias("_to"))
        for j, p in enumerate(probs)])
    brackets = held.select("_k", "_min", "_max", bounds.alias("_b"))

    def counted(brackets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What lies between the bounds, one row per distinct value; bounds with the rows below and between."""
        met = join_small(rows, brackets.select("_k", "_b"), ["_k"], "inner")
        inner = met.select("_k", "_v", F.explode(F.filter("_b", lambda b: _between(F.col("_v"), b["_from"], b["_to"]))).alias("b"))
        part = inner.groupBy("_k", F.col("b._p").alias("_p"), "_v").agg(F.count("*").alias("_n")).checkpoint()
        below = met.groupBy(F.col("_k").alias("_k3")).agg(*[F.count_if(F.col("_v") < F.get("_b", F.lit(j))["_from"]).alias(f"_below{j}") for j in range(len(probs))])
        flat = brackets.select("_k", "_min", "_max", F.inline("_b")).join(below, F.col("_k").eqNullSafe(F.col("_k3")))
        flat = flat.withColumn("_below", F.element_at(F.array(*[F.col(f"_below{j}") for j in range(len(probs))]), F.col("_p") + 1))
        sizes = part.groupBy(F.col("_k").alias("_k2"), F.col("_p").alias("_p2")).agg(F.sum("_n").alias("_inside"), F.count("*").alias("_distinct"))
        done = flat.join(sizes, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_p") == F.col("_p2")), "left")
        return part, done.select("_k", "_p", "_min", "_max", "_low_rank", "_high_rank", "_from", "_to", "_below",
                                 F.coalesce("_inside", F.lit(0)).alias("_inside"), F.coalesce("_distinct", F.lit(0)).alias("_distinct")).checkpoint()

    part, found = counted(brackets)
    if not found.filter("_low_rank < _below OR _high_rank >= _below + _inside").isEmpty():
        whole = F.transform("_b", lambda b: b.withField("_from", F.col("_min")).withField("_to", F.col("_max")))
        part, found = counted(brackets.withColumn("_b", whole))
    places = found.select("_k", "_p", "_low_rank", "_high_rank", "_below")
    largest = found.agg(F.coalesce(F.max("_distinct"), F.lit(0))).first()[0]
    while largest > most:
        part, places, largest = _cut_down(part, places)
    running = F.sum("_n").over(Window.partitionBy("_k", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    line = join_small(part.withColumn("_to", running), places, ["_k", "_p"], "inner").withColumn("_to", F.col("_to") + F.col("_below"))
    holds = [(F.col("_to") > F.col(r)) & (F.col("_to") - F.col("_n") <= F.col(r)) for r in ("_low_rank", "_high_rank")]
    return line.groupBy("_k", "_p").agg(*[F.max(F.when(hit, F.col("_v"))).alias(name) for hit, name in zip(holds, ("_low", "_high"))])


CUTS = 256


def _cut_down(part: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Keep, per key and probability, the pieces between the quantiles of its distinct values that hold its ranks."""
    edges = part.groupBy("_k", "_p").agg(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 100 * CUTS).alias("_e"))
    placed = join_small(part, edges, ["_k", "_p"], "inner").withColumn("_piece", F.size(F.filter("_e", lambda e: e <= F.col("_v")))).drop("_e").checkpoint()
    pieces = placed.groupBy("_k", "_p", "_piece").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_distinct"))
    line = Window.partitionBy("_k", "_p").orderBy("_piece")
    ends = join_small(pieces.withColumn("_end", F.sum("_rows").over(line.rowsBetween(Window.unboundedPreceding, 0))), places, ["_k", "_p"], "inner")
    ends = ends.withColumn("_end", F.col("_end") + F.col("_below"))
    # The piece of the low rank, that of the high rank, and the empty stretch between them.
    wanted = ends.filter((F.col("_end") > F.col("_low_rank")) & (F.col("_end") - F.col("_rows") <= F.col("_high_rank"))).checkpoint()
    kept = join_small(placed, wanted.select("_k", "_p", "_piece", F.lit(True).alias("_wanted")), ["_k", "_p", "_piece"], "inner").drop("_wanted", "_piece").checkpoint()
    nearer = wanted.groupBy("_k", "_p").agg(F.first("_low_rank").alias("_low_rank"), F.first("_high_rank").alias("_high_rank"),
                                            F.min(F.col("_end") - F.col("_rows")).alias("_below")).checkpoint()
    return kept, nearer, wanted.groupBy("_k", "_p").agg(F.sum("_distinct").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], chunks: int | None = None,
    sketch: int = SKETCH, most: int = SORTED,
) -> DataFrame:
    """Exact percentiles per key: one row per key, one column per `{name: probability}`.

    Small inputs use the built-in exact aggregate. It holds a count per distinct value of a group, so larger ones are
    selected between the bounds of a sketch: the column is read a few times, and only what lies around the ranks is
    written or sorted. Either way null and NaN values are left out, and a key without others has a row of nulls.
    """
    n = chunks or planned_chunks(df)
    if n == 1:
        return df.groupBy(*keys).agg(*[F.percentile(_number(value), F.lit(p)).alias(name) for name, p in probs.items()])
    ensure_checkpoints(df.sparkSession)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("_k"), _number(value).cast("double").alias("_v")).filter("_v is not null")
    around = _bracketed(rows, list(probs.values()), sketch, most)
    sizes = rows.groupBy(F.col("_k").alias("_k2")).agg(F.count("*").alias("_size"))
    found = around.join(sizes, F.col("_k") == F.col("_k2"))

    def value_at(p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(position), F.ceil(position)
        return F.when(low == high, F.col("_low")).otherwise((high - position) * F.col("_low") + (position - low) * F.col("_high"))

    picks = found.groupBy("_k").agg(*[F.max(F.when(F.col("_p") == j, value_at(p))).alias(name) for j, (name, p) in enumerate(probs.items())])
    if not keys:
        # One row even for an empty column, as an aggregate has.
        return picks.agg(*[F.max(name).alias(name) for name in probs])
    return join_small(df.select(*keys).distinct(), picks.select("_k.*", *probs), keys)


def column_percentiles(
    df: DataFrame, columns: list[str], probs: dict[str, float], chunks: int | None = None
) -> DataFrame:
    """Exact percentiles of many columns: one row per column (`column`, then the names)."""
    n = chunks or planned_chunks(df)
    if n == 1:
        wide = df.agg(
            *[
                F.percentile(_number(F.col(c).cast("double")), F.lit(p)).alias(f"{i}_{name}")
                for i, c in enumerate(columns)
                for name, p in probs.items()
            ]
        )
        return wide.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"),
                            *[F.col(f"{i}_{name}").alias(name) for name in probs],
                        )
                        for i, c in enumerate(columns)
                    ]
                )
            )
        )
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
            )
        )
    )
    return percentiles(long, ["column"], "value", probs, n)


def carry_last(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunks: int | None = None
) -> DataFrame:
    """Replace each column by its latest non-null value at or before the row."""
    n = chunks or planned_chunks(df)
    if n == 1:
        return df.withColumns(
            {c: F.last(c, ignorenulls=True).over(_within(keys, order)) for c in columns}
        )
    part = chunked(df, keys, order, n)
    position = F.struct(*order)
    ends = part.groupBy(*keys, CHUNK).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_e_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(
        *keys, CHUNK, *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_p_{c}") for c in columns]
    )
    inner = part.withColumns(
        {c: F.last(c, ignorenulls=True).over(_within([*keys, CHUNK], order)) for c in columns}
    )
    return (
        _join_chunks(inner, entry, keys)
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_p_{c}")) for c in columns})
        .drop(CHUNK, *[f"_p_{c}" for c in columns])
    )


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, spread_by: str,
    out: str | None = None, salts: int | None = None,
) -> DataFrame:
    """First `limit` rows of every key.

    The rank filter lets each map task send at most `limit` rows per key. With many
    map tasks that is still a lot for one hot key, so large inputs rank within salted
    shares of the key first: the last step sees salts x limit rows of a key at most.
    """
    n = salts or min(MAX_SALTS, planned_chunks(df))
    if n > 1:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(n)))
        share = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("_rank", share).filter(F.col("_rank") <= limit).drop("_rank", "_salt")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = out or "_rank"
    top = df.withColumn(name, rank).filter(F.col(name) <= limit)
    return top if out else top.drop("_rank")
