"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import config
from driftwell.operators.splits import sample_n
from driftwell.schemas import AUDIT_ENTRY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by suffix, else CSV with a header. Pass a schema to spare the inference pass."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def scan_tabular(source: DataFrame, target: str | None = None, features: list[str] | None = None,
                 max_samples: int | None = None, key: str | None = None) -> DataFrame:
    """Features as float and the target (default: the last column). A cap samples by `key`."""
    target = target or source.columns[-1]
    features = features or [c for c in source.columns if c not in (target, key)]
    keep = [key] if key else []
    rows = source.select(*keep, *[F.col(c).cast("float").alias(c) for c in features], F.col(target).alias("target"))
    if max_samples is None:
        return rows
    if key is None:
        raise ValueError("sampling needs a key column")
    return sample_n(rows, key, max_samples)


def first_text_column(df: DataFrame) -> str:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return texts[0] if texts else df.columns[0]


def scan_text(source: DataFrame, text: str | None = None, target: str | None = None) -> DataFrame:
    """Text (null becomes empty) and label; text defaults to the first string column."""
    text = text or first_text_column(source)
    target = target or source.columns[-1]
    rest = [c for c in source.columns if c not in (text, target)]
    return source.select(
        *rest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(target).alias("label")
    )


def scan_image_arrays(source: DataFrame, vector: str, label: str, key: str, normalize: bool = True) -> DataFrame:
    """Vectors divided by 255 when any value of the whole set exceeds 1; side is floor(sqrt(width))."""
    values = F.col(vector).cast("array<double>")
    if normalize:
        peak = source.agg(F.max(F.array_max(values))).scalar()
        scale = F.when(F.col("_peak") > 1.0, F.lit(255.0)).otherwise(F.lit(1.0))
        scaled = F.transform(values, lambda v: v / scale)
        source = source.withColumn("_peak", peak)
    else:
        scaled = values
    return source.select(
        key, scaled.alias("vector"), F.floor(F.sqrt(F.size(vector).cast("double"))).cast("int").alias("side"),
        F.col(label).alias("label"),
    )


def scan_labelled_dir(spark: SparkSession, folder: str) -> DataFrame:
    """One row per image file; the label is the rank of its directory name. Pixels are not decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    images = files.withColumn("class_name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).filter(
        F.lower("path").rlike(r"\.(png|jpg|jpeg|bmp)$")
    )
    names = images.select("class_name").distinct().agg(F.array_sort(F.collect_set("class_name"))).scalar()
    return images.withColumn("_names", names).select(
        "path", "length", "class_name", (F.array_position("_names", F.col("class_name")) - 1).cast("int").alias("label")
    )


def dataset_info(df: DataFrame, target: str, features: list[str], text: str | None = None) -> DataFrame:
    """Rows, feature count, class labels when there are at most 20, mean text length."""
    kinds = df.select(target).dropna().distinct().orderBy(target).limit(config.MAX_CLASSES + 1)
    labels = kinds.agg(
        F.when(
            F.count("*") <= config.MAX_CLASSES,
            F.concat_ws(",", F.transform(F.array_sort(F.collect_list(target)), lambda v: v.cast("string"))),
        )
    ).scalar()
    length: Column = F.avg(F.length(F.coalesce(text, F.lit("")))) if text else F.lit(None).cast("double")
    return df.agg(F.count("*").alias("num_samples"), length.alias("avg_text_length")).withColumns(
        {
            "num_features": F.lit(len(features)).cast("bigint"),
            "feature_names": F.lit(",".join(features)),
            "class_labels": labels,
        }
    )


def scan_query(spark: SparkSession, query: str, views: dict[str, DataFrame]) -> DataFrame:
    """A configured `database` source: a query over named views (use scan_jdbc for a server)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def scan_jdbc(spark: SparkSession, url: str, query: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """Partitioned read of a database query."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
        .option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", parts).load()
    )


def write_dataset(df: DataFrame, path: str) -> str:
    """Parquet or CSV by suffix; the path must not exist yet."""
    if path.endswith((".parquet", ".pq")):
        df.write.parquet(path)
    else:
        df.write.option("header", True).csv(path)
    return path


def export_path(root: str, model_id: str, epoch: int) -> str:
    return f"{root}/{model_id.replace('-', '_')}/retrain_{epoch}.csv"


def append_logs(rows: DataFrame, path: str) -> None:
    """Append predictions, one folder per day so that recent-log queries prune."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(AUDIT_ENTRY).option("mode", "DROPMALFORMED").json(path)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def audit_query(entries: DataFrame, action: str | None = None, user: str | None = None, limit: int = 100) -> DataFrame:
    """The last `limit` matching entries."""
    rows = entries
    if action:
        rows = rows.filter(F.col("action") == action)
    if user:
        rows = rows.filter(F.col("user") == user)
    return rows.orderBy(F.col("timestamp").desc(), F.col("correlation_id").desc()).limit(limit)


def row_fingerprint(df: DataFrame) -> Column:
    """60-bit hash of a row's values, independent of row order and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def manifest(df: DataFrame, part: Column) -> DataFrame:
    """Row count and two order-free checksums per partition."""
    hashed = df.select(part.alias("part"), row_fingerprint(df).alias("_h"))
    return hashed.groupBy("part").agg(
        F.count("*").alias("rows"),
        F.bit_xor("_h").alias("checksum"),
        F.sum(F.pmod("_h", F.lit(1 << 20))).alias("checksum_sum"),
    )


def data_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions that were added, removed or changed between two manifests."""
    a = old.select("part", *[F.col(c).alias(f"old_{c}") for c in ("rows", "checksum", "checksum_sum")])
    b = new.select("part", *[F.col(c).alias(f"new_{c}") for c in ("rows", "checksum", "checksum_sum")])
    same = (
        (F.col("old_rows") == F.col("new_rows")) & (F.col("old_checksum") == F.col("new_checksum"))
        & (F.col("old_checksum_sum") == F.col("new_checksum_sum"))
    )
    change = (
        F.when(F.col("old_rows").isNull(), F.lit("added"))
        .when(F.col("new_rows").isNull(), F.lit("removed"))
        .when(~same, F.lit("changed"))
    )
    return a.join(b, "part", "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(
        "part", "change", F.coalesce("old_rows", F.lit(0)).alias("old_rows"),
        F.coalesce("new_rows", F.lit(0)).alias("new_rows"),
    )


