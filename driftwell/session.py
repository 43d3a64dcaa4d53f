"""Session settings and the shared folder every multi-stage job writes to."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

# Static keys: they can only be given before a session starts, so only build_session uses them.
BUILD_CONF = {
    # Call-site capture for every column costs seconds on wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Settings the results or plans rely on, all modifiable on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # newest-N-per-model keeps N rows per map task before the shuffle; the
    # largest N used by the log readers is 10,000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build_session(cores: int | str = "*", app: str = "driftwell", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**BUILD_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Give a session somebody else created the settings above, as far as it lets itself be changed.

    A time zone other than UTC is switched with a warning, as timestamps would mean other instants.
    """
    for key, value in RUNTIME_CONF.items():
        current = spark.conf.get(key, None)
        if current == value or not spark.conf.isModifiable(key):
            continue
        if key == "spark.sql.session.timeZone" and current not in ("Etc/UTC", "GMT", "Z"):
            warnings.warn(f"session time zone {current} is switched to UTC", stacklevel=2)
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local master, where driver and executors are one process, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return os.path.join(tempfile.gettempdir(), "driftwell-checkpoints")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make reliable checkpoint() usable without overriding the cluster's folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, never cleared."""
    return f"{shared_dir(spark)}/driftwell/{label}-{uuid.uuid4().hex}"
