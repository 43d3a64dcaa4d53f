"""The queries must run on a session that knows nothing of this library."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BARE = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
folder = "/root/testdata/sf0.001"
assert e.entry(spark).schema
e.entry(spark).collect()
for name in ("scan_tabular", "recent_logs", "best_run", "latency_summary", "request_rate", "norm_cdf"):
    e.queries()[name](spark, folder).collect()
print("BARE OK")
"""


def test_bare_session():
    done = subprocess.run([sys.executable, "-c", BARE], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "BARE OK" in done.stdout, done.stderr[-2000:]
