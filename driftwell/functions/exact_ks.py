"""Exact two-sample KS p-value for small samples: one call per result row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXACT_LIMIT = 10_000


def exact_ks_p(d: float, n: int, m: int) -> float:
    """Share of lattice paths (0,0)->(n,m) that somewhere reach a distance of d or more.

    Row by row: the paths that stay inside the band are a running sum of the
    previous row clipped to the band. Rows are rescaled so nothing overflows.
    """
    lcm = n * m // math.gcd(n, m)
    reach = round(d * lcm)
    if reach <= 0:
        return 1.0
    step_n, step_m = lcm // n, lcm // m
    j = np.arange(m + 1, dtype=np.int64)
    log_scale = 0.0
    row = np.where(np.abs(j * step_m) < reach, 1.0, 0.0)
    row = np.where(np.cumsum(row == 0) > 0, 0.0, row)
    for i in range(1, n + 1):
        inside_band = np.abs(i * step_n - j * step_m) < reach
        row = np.where(inside_band, np.cumsum(np.where(inside_band, row, 0.0)), 0.0)
        peak = row.max()
        if peak == 0.0:
            return 1.0
        row /= peak
        log_scale += math.log(peak)
    if row[m] == 0.0:
        return 1.0
    log_paths = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    inside = math.exp(log_scale + math.log(row[m]) - log_paths)
    return float(min(1.0, max(0.0, 1.0 - inside)))


@F.pandas_udf(DoubleType())
def exact_ks_p_udf(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(
        [
            exact_ks_p(dv, int(nv), int(mv)) if max(nv, mv) <= EXACT_LIMIT and min(nv, mv) > 0 else None
            for dv, nv, mv in zip(d, n, m)
        ],
        dtype="float64",
    )
