"""Probability functions as native column expressions (no Python on the rows)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ERF_TERMS = 120
_ERF_LIMIT = 6.0
_KOLMOGOROV_TERMS = 100


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner evaluation; coefficients are ordered from the constant term up."""
    terms = F.expr("array(" + ", ".join(f"{float(c)!r}D" for c in reversed(coefficients)) + ")")
    return F.aggregate(terms, F.lit(0.0), lambda acc, c: acc * x + c)


def erf(x: Column) -> Column:
    """erf(x) = exp(-x^2) * sum x^(2n+1) / gamma(n + 3/2): all terms positive, so it is stable."""
    size = F.abs(x)
    series = _polynomial(size * size, [1.0 / math.gamma(n + 1.5) for n in range(_ERF_TERMS)])
    magnitude = F.when(size >= _ERF_LIMIT, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.exp(-size * size) * size * series)
    )
    return F.when(x.isNotNull(), F.signum(x) * magnitude)


def norm_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def two_sided_normal_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - norm_cdf(F.abs(z)))


def chi2_cdf1(x: Column) -> Column:
    """Chi-square CDF with one degree of freedom; 0 at or below zero."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(erf(F.sqrt(F.greatest(x, F.lit(0.0)) / 2)))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square for a whole number of degrees of freedom (closed form)."""
    half = F.greatest(x, F.lit(0.0)) / 2
    if df % 2 == 0:
        tail = F.exp(-half) * _polynomial(half, [1.0 / math.factorial(k) for k in range(df // 2)])
    else:
        tail = F.lit(1.0) - erf(F.sqrt(half))
        if df > 1:
            series = _polynomial(half, [1.0 / math.gamma(k + 1.5) for k in range((df - 1) // 2)])
            tail = tail + F.exp(-half) * F.sqrt(half) * series
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def kolmogorov_sf(lam: Column) -> Column:
    """2 * sum (-1)^(j-1) exp(-2 j^2 lam^2), the limiting two-sided distribution."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(_KOLMOGOROV_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * terms))
    )


def ks_asymptotic_p(d: Column, n: Column, m: Column) -> Column:
    """Large-sample two-sided p-value with the finite-size shift of the argument.

    The effective size is nm/(n+m), rounded; the shift 1/(6 sqrt N) + (z-1)/(4N)
    is the published correction to the limiting law.
    """
    size = F.greatest(F.lit(1.0), F.round(n.cast("double") * m / (n + m)))
    z = d * F.sqrt(size)
    shifted = z + F.lit(1.0) / (6.0 * F.sqrt(size)) + (z - 1.0) / (4.0 * size)
    return F.when(d <= 0, F.lit(1.0)).otherwise(kolmogorov_sf(F.greatest(shifted, F.lit(0.0))))
