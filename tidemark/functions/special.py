"""Distribution functions for the one row that a test leaves on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or df <= 0 or not math.isfinite(t):
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_upper(t: float | None, df: float | None) -> float | None:
    """P(T >= t)."""
    p = t_two_sided(t, df)
    return None if p is None else (p / 2 if t >= 0 else 1 - p / 2)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


#: A row each for a finished test: plain Python is enough here.
_two_sided = F.udf(t_two_sided, T.DoubleType())
_upper = F.udf(t_upper, T.DoubleType())


def p_two_sided(t: str | Column, df: str | Column) -> Column:
    return _two_sided(t, df)


def p_upper(t: str | Column, df: str | Column) -> Column:
    return _upper(t, df)
