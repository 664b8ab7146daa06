"""Statistics as Column expressions: nothing here runs Python on executors."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of the complementary error function (relative error below 1.2e-7)
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
CLAMP, TINY, RIDGE, METRIC_TINY, LEAST_VARIANCE = 0.999999, 1e-12, 1e-8, 1e-8, 1e-6


def critical_z(alpha: float) -> float:
    """The |z| that a two-sided p below alpha needs."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def erfc(x: Column) -> Column:
    """For x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    return t * F.exp(reduce(lambda a, c: F.lit(c) + t * a, reversed(ERFC[:-1]), F.lit(ERFC[-1])) - x * x)


def erfc_sql(x: str) -> str:
    t = f"(CAST(1 AS DOUBLE) / (1 + CAST(0.5 AS DOUBLE) * ({x})))"
    inner = reduce(lambda a, c: f"(CAST({c} AS DOUBLE) + {t} * {a})", reversed(ERFC[:-1]), f"CAST({ERFC[-1]} AS DOUBLE)")
    return f"({t} * exp({inner} - ({x}) * ({x})))"


def z_of(r: Column, n: Column, covariates: int = 0) -> Column:
    """The normal-tail statistic of a (partial) correlation; r is clamped."""
    df = n - 2 - covariates
    r = F.greatest(F.least(r, F.lit(CLAMP)), F.lit(-CLAMP))
    return r * F.sqrt(df / (1 - r * r)) / F.sqrt(df / (df + 1))


def p_of(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.lit(2.0**0.5)))


def correlation(cross: Column, xx: Column, yy: Column) -> Column:
    return F.greatest(F.least(cross / (F.sqrt(F.greatest(xx * yy, F.lit(0.0))) + TINY), F.lit(CLAMP)), F.lit(-CLAMP))


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
