"""Code tables: a number for every distinct value of a column, however many there are.

Distinct values are ranked by a range partition plus the counts of the ranges before, so no task and no driver sees
them all. The table is written, measured, and met by `join_small`: broadcast while it is small, else shuffled on the
value, where adaptive execution splits hot values of the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.ordered import numbered, planned_chunks
from driftwell.operators.smallside import join_small
from driftwell.session import ensure_checkpoints


def code_table(df: DataFrame, column: str, chunks: int | None = None) -> DataFrame:
    """(value, code): the distinct non-null values with their place 0, 1, ... in sorted order."""
    n = chunks or planned_chunks(df)
    ensure_checkpoints(df.sparkSession)
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    ranked = numbered(values, [], ["value"], "code", n)
    return ranked.select("value", (F.col("code") - 1).cast("int").alias("code")).checkpoint()


def with_code(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """The frame with the code of `column` as `out`; null where the table does not know the value."""
    return join_small(df, table.select(F.col("value").alias(column), F.col("code").alias(out)), [column])


def unit_vector(code: Column, size: int) -> Column:
    """A 0/1 vector of `size` places in sparse form: the places that are 1 and their values. No code, or one outside,
    gives a vector of zeros."""
    one = (code >= 0) & (code < size)
    return F.struct(
        F.lit(size).alias("size"),
        F.when(one, F.array(code)).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(one, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )
