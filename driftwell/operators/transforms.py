"""Feature transforms: fit once on a frame, then apply as plain column expressions.

`fit` runs one small aggregate (one value per column or a short category list) and
keeps the numbers on the driver; `transform` adds projections only. Encoders of columns
with many categories keep a written code table instead, which `transform` joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.operators.codes import code_table, unit_vector, with_code
from driftwell.operators.ordered import column_percentiles
from driftwell.operators.quality import nan_to_null, numeric_columns

WIDE = 10_000  # categories that become a column each
INLINE = 1_000  # categories that a plan holds as a list


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _one_row(df: DataFrame, measures: list[Column]) -> dict:
    return df.agg(*measures).first().asDict()


def _replace(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: e for c, e in columns.items() if c in df.columns})


def categories(df: DataFrame, column: str, limit: int) -> list | None:
    """Sorted distinct non-null values; None if there are more than `limit`."""
    rows = df.select(column).dropna().distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else None


class Transform:
    columns: list[str] | None

    def fit(self, df: DataFrame) -> "Transform":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class StandardScaler(Transform):
    """(x - mean) / sample std; a zero spread divides by 1."""

    columns: list[str] | None = None
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "StandardScaler":
        columns = self.columns or numeric_columns(df)
        clean = nan_to_null(df.select(*columns))
        row = _one_row(
            clean,
            [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
            + [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
        )
        # A single row has no sample std; scaling by it yields null, as dividing by NaN does.
        self.stats = {
            c: (row[f"m{i}"], 1.0 if row[f"s{i}"] == 0 else row[f"s{i}"]) for i, c in enumerate(columns)
        }
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return _replace(
            df,
            {
                c: (F.col(c) - F.lit(m).cast("double")) / F.lit(s).cast("double")
                for c, (m, s) in self.stats.items()
            },
        )


@dataclass
class MinMaxScaler(Transform):
    """(x - min) / (max - min); a constant column becomes 0 in every row, nulls included."""

    columns: list[str] | None = None
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MinMaxScaler":
        columns = self.columns or numeric_columns(df)
        clean = nan_to_null(df.select(*columns))
        row = _one_row(
            clean,
            [F.min(c).cast("double").alias(f"l{i}") for i, c in enumerate(columns)]
            + [F.max(c).cast("double").alias(f"h{i}") for i, c in enumerate(columns)],
        )
        self.stats = {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.stats.items():
            if lo is not None and hi == lo:
                out[c] = F.lit(0.0)
            else:
                span = None if lo is None else hi - lo
                out[c] = (F.col(c) - F.lit(lo).cast("double")) / F.lit(span).cast("double")
        return _replace(df, out)


@dataclass
class LogTransform(Transform):
    """log(1 + max(x, 0)); nulls stay null."""

    columns: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.columns or numeric_columns(df)
        zero = F.lit(0.0)
        return _replace(
            df, {c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), zero))) for c in columns}
        )


@dataclass
class Imputer(Transform):
    """Fill missing values with the mean, the exact median or a constant."""

    strategy: str = "median"
    fill_value: float = 0.0
    columns: list[str] | None = None
    fills: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Imputer":
        columns = self.columns or numeric_columns(df)
        clean = nan_to_null(df.select(*columns))
        if self.strategy == "mean":
            row = _one_row(clean, [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])
            self.fills = {c: row[f"m{i}"] for i, c in enumerate(columns)}
        elif self.strategy == "median":
            rows = column_percentiles(clean, columns, {"median": 0.5}).collect()  # one row per column
            self.fills = {r["column"]: r["median"] for r in rows}
        else:
            self.fills = {c: self.fill_value for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        clean = nan_to_null(df)
        return _replace(
            clean, {c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in self.fills.items()}
        )


@dataclass
class OneHotEncoder(Transform):
    """0/1 columns per category in sorted order, the first one dropped by default.

    Nulls and categories not seen in `fit` are 0 everywhere; the source column goes. A column of more than `wide`
    categories becomes one column `<name>_onehot` instead, a 0/1 vector in sparse form (size, indices, values) over the
    same sorted categories: there is no limit to their number.
    """

    columns: list[str] | None = None
    drop_first: bool = True
    wide: int = WIDE
    seen: dict[str, list] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OneHotEncoder":
        self.seen, self.tables = {}, {}
        for c in self.columns or text_columns(df):
            values = categories(df, c, self.wide)
            if values is None:
                self.tables[c] = code_table(df, c)
            else:
                self.seen[c] = values
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        added, gone = {}, []
        for c, values in self.seen.items():
            if c not in df.columns:
                continue
            gone.append(c)
            for v in values[1:] if self.drop_first else values:
                added[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
        df = df.withColumns(added).drop(*gone) if added else df.drop(*gone)
        for c, table in self.tables.items():
            if c not in df.columns:
                continue
            first = int(self.drop_first)
            size = table.count() - first
            coded = with_code(df, c, table, "_code")
            df = coded.withColumn(f"{c}_onehot", unit_vector(F.col("_code") - first, size)).drop("_code", c)
        return df


@dataclass
class OrdinalEncoder(Transform):
    """Index in the sorted categories; unknown and null become -1. Any number of categories."""

    columns: list[str] | None = None
    inline: int = INLINE
    seen: dict[str, list] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        self.seen, self.tables = {}, {}
        for c in self.columns or text_columns(df):
            values = categories(df, c, self.inline)
            if values is None:
                self.tables[c] = code_table(df, c)
            else:
                self.seen[c] = values
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = _replace(df, {c: F.coalesce(_place(F.col(c), values), F.lit(-1)) for c, values in self.seen.items()})
        columns = df.columns
        for c, table in self.tables.items():
            if c in columns:
                code = F.coalesce("_code", F.lit(-1)).alias(c)
                df = with_code(df, c, table, "_code").select(*(code if x == c else F.col(x) for x in columns))
        return df


def _place(value: Column, values: list) -> Column:
    """Index among sorted values, null if not there."""
    known = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    return (F.array_position(known, value) - 1).cast("int")


@dataclass
class TransformChain:
    """Steps fitted in order, each on the output of the ones before."""

    steps: list[Transform] = field(default_factory=list)

    def add(self, step: Transform) -> "TransformChain":
        self.steps.append(step)
        return self

    def fit(self, df: DataFrame) -> "TransformChain":
        current = df
        for step in self.steps:
            current = step.fit_transform(current)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def describe(self) -> list[dict]:
        return [{"step": i, "type": type(s).__name__} for i, s in enumerate(self.steps)]


def label_encode(df: DataFrame, label: str, out: str = "label_index", inline: int = INLINE) -> DataFrame:
    """Index of each string label among the sorted distinct labels, however many there are."""
    values = categories(df, label, inline)
    if values is None:
        return with_code(df, label, code_table(df, label), out)
    return df.withColumn(out, _place(F.col(label), values))


def engineer_credit_features(df: DataFrame, duration: str, credit: str, installment: str, age: str,
                             existing: str, employment: str, checking: str, savings: str) -> DataFrame:
    """Ten ratio, product and log features; 1e-8 keeps the ratios finite."""
    eps = F.lit(1e-8)
    d, c, i, a, e = (F.col(x) for x in (duration, credit, installment, age, existing))
    emp, chk, sav = (F.col(x) for x in (employment, checking, savings))
    return df.withColumns(
        {
            "credit_per_month": F.try_divide(c, d + eps),
            "age_credit_ratio": F.try_divide(a, c + eps),
            "installment_credit_ratio": F.try_divide(i, c + eps),
            "age_employment_score": a * (emp + 1),
            "credit_risk_density": F.try_divide(c * i, d + eps),
            "duration_installment": d * i,
            "checking_savings_interact": chk * sav,
            "age_checking_interact": a * chk,
            "credit_existing_interact": c * e,
            "log_credit_amount": F.log1p(F.abs(c)),
        }
    )


def map_columns(df: DataFrame, mapping: dict[str, tuple[str, str]], target: Column) -> DataFrame:
    """Rename and cast `{new: (old, type)}` and add the 0/1 target."""
    return df.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in mapping.items()],
                     target.cast("int").alias("target"))
