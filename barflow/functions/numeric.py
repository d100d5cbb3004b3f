"""Numeric column helpers with pandas-like null and zero handling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(c: str | Column, eps: float) -> Column:
    """Exact zeros become ``eps``; everything else (null included) is unchanged."""
    c = col(c)
    return F.when(c == 0, F.lit(eps)).otherwise(c)


def at_least(c: str | Column, lo: float) -> Column:
    """Lower clip that keeps null (``greatest`` would skip it)."""
    c = col(c)
    return F.when(c < lo, F.lit(lo)).otherwise(c)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def ratio(a: str | Column, b: str | Column, eps: float | None = None) -> Column:
    """a / b; a zero denominator gives null, or is replaced by ``eps``."""
    return F.try_divide(col(a), col(b) if eps is None else nonzero(b, eps))


def quotient(a: str | Column, b: str | Column) -> Column:
    """a / b as floating-point numbers divide: infinity over zero, NaN for 0 / 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(F.try_divide(a, b))


def log(c: str | Column) -> Column:
    """Natural logarithm; that of zero is minus infinity (``F.ln`` has null)."""
    c = col(c)
    return F.when(c == 0, F.lit(-math.inf)).otherwise(F.ln(c))


def sign3(up: Column, down: Column) -> Column:
    """+1 / -1 / 0 from two predicates; unknown predicates count as false."""
    return F.when(up, 1.0).when(down, -1.0).otherwise(0.0)


def flag(cond: Column) -> Column:
    """1 / 0 with unknown as 0."""
    return F.when(cond, 1).otherwise(0)


def erf(x: Column) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz and Stegun (|error| < 1.5e-7)."""
    # fixed values: coefficients of formula 7.1.26
    p, coeffs = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(coeffs):
        poly = (poly + c) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))
