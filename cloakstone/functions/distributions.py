"""Tail probabilities and quantiles for aggregate rows.

These run on one row per stratum, never on data rows, so the Arrow hop costs nothing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Nodes of the double exponential rule on (0, inf): x = exp(pi/2 sinh u), u from -6 to 6.
_STEP = 1 / 32
_NODES = [k * _STEP for k in range(-192, 193)]
_REACH = [math.exp(math.pi / 2 * math.sinh(u)) for u in _NODES]
_LOG_WEIGHT = [math.log(math.pi / 2 * math.cosh(u) * _STEP) + math.pi / 2 * math.sinh(u) for u in _NODES]


def log_gamma_ratio(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)) without the loss of subtracting two large logarithms.

    Thirty steps of the recurrence, then the asymptotic series, at every size of ``a``.
    """
    log = sum(math.log((a + k) / (a + k + 0.5)) for k in range(30))
    a += 30
    return log + 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t: the density integrated from |t| on, one rule for all degrees."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    t = abs(t)
    constant = math.log(2) + log_gamma_ratio(df / 2) - 0.5 * math.log(df * math.pi)
    power = -(df + 1) / 2

    def log_density(x: float) -> float:
        ratio = x / math.sqrt(df)
        # log(1 + ratio**2), also where the square would overflow
        return power * (math.log1p(ratio * ratio) if ratio < 1e150 else 2 * math.log(ratio))

    total = math.fsum(
        math.exp(constant + log_density(t + x) + w) for x, w in zip(_REACH, _LOG_WEIGHT, strict=True)
    )
    return min(1.0, total)


def t_critical(level: float, df: float) -> float:
    """The t with P(|T| <= t) = level, by bisection on the two-sided tail."""
    if math.isnan(df) or df <= 0:
        return math.nan
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        if t_two_sided(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def chi2_upper(x: float, df: float) -> float:
    """P(X >= x) for chi-square, by the series or the continued fraction of the gamma tail.

    NaN if the fraction does not converge.
    """
    if math.isnan(x) or math.isnan(df) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return 1.0 - scale * total
    b = z + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return scale * value
    return math.nan  # not converged: no value rather than a wrong one


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    rows = zip(*(c.astype("float64") for c in columns), strict=True)
    return pd.Series([fn(*row) for row in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_quantile(level: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_critical, level, df)


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_upper, x, df)
