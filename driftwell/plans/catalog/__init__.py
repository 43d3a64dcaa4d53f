"""All registered queries."""

from driftwell.plans.catalog import (  # noqa: F401
    datasets,
    drifts,
    logs,
    models,
    rules,
    streams,
)
from driftwell.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
