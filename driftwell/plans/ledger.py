"""A ledger of job runs: one folder per log, one folder per run in it.

Every step of a run writes its rows under the run's id. A run that comes again, after a failure or by hand, replaces
what it wrote before and leaves other runs alone, so each log holds every run once. Folders are only reached through
Spark, so the ledger may lie in any store Spark writes to.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "heal_id"


class Ledger:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def put(self, log: str, run: str, rows: DataFrame) -> DataFrame:
        """Write a run's rows of a log in place of its earlier ones; the rows as stored."""
        shape = self.spark.createDataFrame([], self.schemas[log]).schema
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in shape)).write.mode("overwrite").parquet(f"{self.root}/{log}/{RUN}={run}")
        return self.rows(log).filter(F.col(RUN) == run)

    def rows(self, log: str) -> DataFrame:
        """All runs' rows of a log, with the run's id; none if nothing was written yet."""
        schema = f"{self.schemas[log]}, {RUN} string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{log}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
