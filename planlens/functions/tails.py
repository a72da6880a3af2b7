"""Tail probabilities for small result tables (one row per test, never per data row)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1 / TINY
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or TINY)
        c = 1 + even / c or TINY
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or TINY)
        c = 1 + odd / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def fisher_2x2(a: float, row: float, col: float, n: float) -> float:
    """Two-sided Fisher exact p; ``a`` is one cell, ``row`` and ``col`` its margins."""
    lg = math.lgamma

    def log_p(k: float) -> float:
        return (lg(col + 1) - lg(k + 1) - lg(col - k + 1) + lg(n - col + 1) - lg(row - k + 1)
                - lg(n - col - row + k + 1) - (lg(n + 1) - lg(row + 1) - lg(n - row + 1)))
    seen, p = log_p(a), 0.0
    for k in range(int(max(0, row + col - n)), int(min(row, col)) + 1):
        if log_p(k) <= seen + 1e-10:
            p += math.exp(log_p(k))
    return min(1.0, p)


def _safe(fn, *args):
    if any(v is None or math.isnan(v) for v in args):
        return None
    return fn(*args)


def _udf(fn, arity: int):
    """Arrow-batched function of double columns."""
    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda x: _safe(fn, x))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_safe(fn, *v) for v in zip(a, b)], dtype="float64")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_safe(fn, *v) for v in zip(a, b, c)], dtype="float64")

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_safe(fn, *v) for v in zip(a, b, c, d)], dtype="float64")
    return F.pandas_udf([one, two, three, four][arity - 1], T.DoubleType())


normal_p = _udf(normal_two_sided, 1)
chi2_p = _udf(chi2_upper, 2)
t_p = _udf(t_two_sided, 2)
f_p = _udf(f_upper, 3)
fisher_p = _udf(fisher_2x2, 4)


def corr_two_sided(r: float, n: float) -> float:
    """p-value of a correlation by Student t with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


corr_p = _udf(corr_two_sided, 2)
