"""Feature store over a long table: feature_values(entity_id, feature, value, event_ts, expires_at).

Writes append rows; the current value of a field is the one with the latest
event_ts. Aggregates by entity combine on the map side, so a hot entity costs one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.ordered import carry_last


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge by field: fields not in `changes` keep their value."""
    return store.unionByName(changes, allowMissingColumns=True)


def latest_values(store: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Current value per (entity, feature); expired rows are gone when `as_of` is given."""
    rows = store
    if as_of is not None and "expires_at" in store.columns:
        rows = store.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return rows.groupBy("entity_id", "feature").agg(
        F.max_by("value", F.struct("event_ts", "value")).alias("value"),
        F.max("event_ts").alias("event_ts"),
    )


def batch_counts(changes: DataFrame) -> DataFrame:
    """What a batch write reports: entities and fields touched."""
    return changes.agg(
        F.countDistinct("entity_id").alias("entities"),
        F.countDistinct("entity_id", "feature").alias("fields"),
        F.count("*").alias("rows"),
    )


def _vector(names: list[str], prefix: str = "") -> tuple[list[Column], Column]:
    """Aggregates that pick the latest value per name, and whether any exists."""
    picks = [
        F.max_by(
            F.col("value"),
            F.when((F.col("feature") == n) & F.col("value").isNotNull(), F.struct("event_ts", "value")),
        ).alias(f"{prefix}{i}")
        for i, n in enumerate(names)
    ]
    return picks, F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(len(names))])


def entity_vectors(store: DataFrame, names: list[str]) -> DataFrame:
    """One row per entity with the named features in order; missing ones are 0.0.

    Entities that have none of the named features are left out, so a left join
    gives them null.
    """
    picks, vector = _vector(names, "_f")
    wide = store.filter(F.col("feature").isin(names)).groupBy("entity_id").agg(*picks)
    return wide.select("entity_id", vector.alias("features"))


def online_features(requests: DataFrame, store: DataFrame, names: list[str]) -> DataFrame:
    """Feature vector per request; null when the entity is unknown."""
    return requests.join(entity_vectors(store, names), "entity_id", "left")


def enrich_requests(requests: DataFrame, store: DataFrame, names: list[str]) -> DataFrame:
    """Fill `features` from the store only where a request brought none."""
    looked_up = entity_vectors(store, names).withColumnRenamed("features", "_stored")
    return (
        requests.join(looked_up, "entity_id", "left")
        .withColumn("features", F.coalesce("features", "_stored"))
        .drop("_stored")
    )


def historical_features(labels: DataFrame, store: DataFrame, names: list[str],
                        max_age_seconds: float | None = None, chunks: int | None = None,
                        keep: list[str] | None = None) -> DataFrame:
    """Point-in-time lookup: for every label row the latest value at or before its time.

    Labels carry entity_id, label_id and ts, and any columns to `keep`. Labels and feature rows are merged into
    one time line per entity and values are carried forward, so nothing is joined by
    range and no label row is copied per feature. Hot entities are cut into chunks.
    """
    slots = [f"_v{i}" for i in range(len(names))]
    facts = store.filter(F.col("feature").isin(names) & F.col("value").isNotNull()).select(
        "entity_id",
        F.col("event_ts").alias("ts"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("label_id"),
        *[F.lit(None).cast(labels.schema[c].dataType).alias(c) for c in keep or []],
        *[
            F.when(F.col("feature") == n, F.struct(F.col("value"), F.col("event_ts").alias("seen"))).alias(s)
            for n, s in zip(names, slots)
        ],
    )
    asked = labels.select(
        "entity_id", "ts", F.lit(1).alias("_kind"), F.col("label_id").cast("bigint").alias("label_id"),
        *(keep or []),
        *[F.lit(None).cast(facts.schema[s].dataType).alias(s) for s in slots],
    )
    line = carry_last(
        facts.unionByName(asked), ["entity_id"], ["ts", "_kind", "label_id"], slots, chunks
    ).filter("_kind = 1")

    def value(slot: str) -> Column:
        found = F.col(slot)["value"]
        if max_age_seconds is None:
            return found
        age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col(slot)["seen"].cast("timestamp"))
        return F.when(age <= int(max_age_seconds * 1_000_000), found)

    return line.select("entity_id", "label_id", "ts", *(keep or []), *[value(s).alias(n) for n, s in zip(names, slots)])


def training_dataset(labels: DataFrame, store: DataFrame, names: list[str], path: str | None = None,
                     max_age_seconds: float | None = None, chunks: int | None = None) -> DataFrame:
    """Labels with their point-in-time features (0.0 where none existed yet), optionally written."""
    features = historical_features(labels, store, names, max_age_seconds, chunks, ["label"])
    rows = features.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
    if path is None:
        return rows
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ttl_seconds(store: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Seconds an entity's features live on: -1 without expiry, -2 when missing or expired.

    Each write with a TTL resets the entity's expiry; a write without one leaves it.
    """
    state = store.groupBy("entity_id").agg(
        F.max_by("expires_at", F.when(F.col("expires_at").isNotNull(), F.col("event_ts"))).alias("_expires")
    ).withColumn("_known", F.lit(True))
    left = (F.unix_micros(F.col("_expires").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    code = (
        F.when(F.col("_known").isNull(), F.lit(-2))
        .when(F.col("_expires").isNull(), F.lit(-1))
        .when(left <= 0, F.lit(-2))
        .otherwise(F.floor(left))
    )
    return entities.join(state, "entity_id", "left").select("entity_id", code.cast("bigint").alias("ttl"))


def delete_entities(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("entity_id"), "entity_id", "left_anti")


def deleted_count(store: DataFrame, gone: DataFrame) -> DataFrame:
    """How many of the named entities existed."""
    return store.select("entity_id").distinct().join(gone.select("entity_id"), "entity_id", "left_semi").agg(
        F.count("*").alias("deleted")
    )


def list_entities(store: DataFrame, prefix: str = "", limit: int | None = 100) -> DataFrame:
    """Distinct entity ids by prefix, in order."""
    found = store.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    if prefix:
        found = found.filter(F.col("entity_id").startswith(prefix))
    ordered = found.orderBy("entity_id")
    return ordered if limit is None else ordered.limit(limit)


def entity_feature_counts(store: DataFrame) -> DataFrame:
    """Names and number of features per entity; names per entity are bounded by the feature list."""
    names = F.array_sort(F.collect_set("feature"))
    return store.groupBy("entity_id").agg(names.alias("_names")).select(
        "entity_id", F.size("_names").cast("bigint").alias("feature_count"),
        F.concat_ws(",", "_names").alias("feature_names"),
    )


def reference_snapshot(training: DataFrame, features: list[str], model_id: str, version: str) -> DataFrame:
    """Long table of the training values of every feature."""
    wide = training.select(*[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot([], features, "feature_name", "value").select(
        F.lit(model_id).alias("model_id"), F.lit(version).alias("version"), "feature_name", "value"
    )
