"""Exact sampling, splitting and fold assignment by a hash order.

Choosing exactly k rows of a class needs a rank, and ranking a whole class would
put it into one task. The hash order is uniform, so it is cut into equal cells:
counting rows per (class, cell) finds the one cell in which the k-th row lies, and
only rows of that cell are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.smallside import join_small, scanned_bytes


def hash_order(key: str, seed: int | Column) -> Column:
    """60 bits of the md5 of key and seed, so other engines can reproduce the order."""
    text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _cell_bits(df: DataFrame) -> int:
    """About a million scanned bytes per cell: 16 cells at least, 2^20 at most."""
    cells = max(16, min(1 << 20, scanned_bytes(df) >> 20))
    return cells.bit_length() - 1


def _cells(df: DataFrame, key: str, seed: int | Column, bits: int) -> DataFrame:
    return df.withColumn("_h", hash_order(key, seed)).withColumn("_cell", F.shiftright("_h", 60 - bits))


def _cuts(cells: DataFrame, keys: list[str], take: Column) -> DataFrame:
    """Per class: the cell in which the last wanted row lies and how many rows to take of it.

    `take` is a column over `_size`, the rows of the class. The window runs over the
    count table, whose size is classes x cells.
    """
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns(
        {"_to": F.sum("_n").over(running), "_size": F.sum("_n").over(whole)}
    ).withColumn("_want", F.least(take, F.col("_size")).cast("bigint"))
    edge = ranked.filter("_want > _to - _n AND _want <= _to")
    return edge.select(
        *keys, F.col("_cell").alias("_edge"), (F.col("_want") - F.col("_to") + F.col("_n")).alias("_rest")
    )


def lowest(df: DataFrame, key: str, classes: list[str], take: Column, seed: int,
           out: str = "selected") -> DataFrame:
    """Flag, per class, the `take` rows that come first in the hash order."""
    columns = df.columns
    cells = _cells(df, key, seed, _cell_bits(df))
    cuts = _cuts(cells, classes, take)
    if classes:
        placed = join_small(cells, cuts, classes)  # one row per class
    else:
        cut = cuts.select(F.struct("_edge", "_rest")).scalar()
        placed = cells.withColumn("_cut", cut).select(*cells.columns, "_cut._edge", "_cut._rest")
    before = F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(False))
    in_edge = F.coalesce(F.col("_cell") == F.col("_edge"), F.lit(False))
    settled = placed.filter(~in_edge).select(*columns, before.alias(out))
    rank = F.row_number().over(Window.partitionBy(*classes, "_cell").orderBy("_h", key))
    ranked = placed.filter(in_edge).select(*columns, (rank <= F.col("_rest")).alias(out))
    return settled.unionByName(ranked)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones every time."""
    return lowest(df, key, [], F.lit(n), seed).filter("selected").drop("selected")


def train_test_split(df: DataFrame, key: str, label: str | None = None, test_size: float = 0.2,
                     seed: int = 42, max_classes: int | None = None) -> DataFrame:
    """Add `is_test`, stratified by `label`. With `max_classes`, a label of more values does not stratify (counts them first)."""
    classes: list[str] = []
    if label is not None and max_classes is None:
        classes = [label]
    elif label is not None:
        kinds = df.select(label).distinct().limit(max_classes + 1).count()
        classes = [label] if kinds <= max_classes else []
    return lowest(df, key, classes, F.round(F.col("_size") * test_size), seed, "is_test")


def _folds(df: DataFrame, key: str, classes: list[str], folds: int, seed: int | Column) -> DataFrame:
    """A row's rank in its class is the rank in its cell plus the rows of earlier cells."""
    columns = df.columns
    cells = _cells(df, key, seed, _cell_bits(df))
    counts = cells.groupBy(*classes, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*classes).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*classes, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(*classes, "_cell").orderBy("_h", key)) - 1
    ranked = cells.withColumn("_inner", inner).join(offsets, [*classes, "_cell"])
    return ranked.select(*columns, F.pmod(F.col("_offset") + F.col("_inner"), F.lit(folds)).cast("int").alias("fold"))


def kfold(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold number 0..folds-1; fold sizes per class differ by at most one."""
    return _folds(df, key, [label], folds, seed)


def repeated_kfold(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 3,
                   seed: int = 42) -> DataFrame:
    """Fold numbers for every repeat: one row per (row, repeat).

    All repeats are ranked at once, as classes of their own: the table is read as often for ten repeats as for one.
    """
    many = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    ranked = _folds(many, key, ["repeat", label], folds, F.lit(seed) + F.col("repeat"))
    return ranked.select(*df.columns, "fold", "repeat")
