"""Survival functions for the few p-values of the analysis steps.

No statistics library is installed, so the regularized incomplete beta and
gamma functions are evaluated here (Lentz continued fraction / power series,
the textbook forms). They run only on result rows (one per feature), wrapped
in Arrow-batched pandas UDFs, never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 500


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _MAX_ITER + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _beta_cf(a, b, x) / a
    return 1.0 - bt * _beta_cf(b, a, 1.0 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER + 1):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def f_sf(f: float, d1: float, d2: float) -> float | None:
    """P(F(d1, d2) > f)."""
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return None
    if math.isnan(f):
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float | None:
    """P(chi2(k) > x)."""
    if x is None or k is None or k <= 0 or math.isnan(x):
        return None
    if x <= 0:
        return 1.0
    return gammainc_upper(k / 2.0, x / 2.0)


def _none_to_nan(v):
    return float("nan") if v is None else v


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    out = [f_sf(a, b, c) if pd.notna(a) and pd.notna(b) and pd.notna(c) else None
           for a, b, c in zip(f, d1, d2)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    out = [chi2_sf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, k)]
    return pd.Series(out, dtype="float64")


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_pvalue(x: Column, k: Column) -> Column:
    return chi2_sf_udf(x.cast("double"), k.cast("double"))
