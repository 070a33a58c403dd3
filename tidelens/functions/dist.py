"""Distribution functions: normal, Student t, F and chi-squared.

Scalar Python on purpose: they serve results of a few hundred rows, through Arrow UDFs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper tail."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_p(x: float, df: float) -> float:
    """Upper tail."""
    return 1 - gamma_inc(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_p(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_p(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def _over(f, *cols: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(*s: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in x) or any(v <= 0 for v in x[1:]) else f(*x) for x in zip(*s, strict=True)], dtype="Float64").astype("object")

    return run(*(c.cast("double") for c in cols))


def normal_p_col(z: Column) -> Column:
    """Two-sided, as an expression: the series of erf below 2, the continued fraction of erfc above."""
    x = F.abs(z.cast("double")) / math.sqrt(2)
    first = F.struct((2 / math.sqrt(math.pi) * x).alias("t"), F.lit(0.0).alias("s"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(40)), first, lambda a, n: F.struct((a["t"] * x * x / (n + 1.5)).alias("t"), (a["s"] + a["t"]).alias("s")))["s"]
    tail = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / 2 / f)
    return F.when(x < 2, 1 - F.exp(-x * x) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / tail)


def t_p_col(t: Column, df: Column) -> Column:
    return _over(t_p, t, df)


def f_p_col(f: Column, d1: Column, d2: Column) -> Column:
    return _over(f_p, f, d1, d2)


def chi2_p_col(x: Column, df: Column) -> Column:
    return _over(chi2_p, x, df)


def t_quantile_col(p: Column, df: Column) -> Column:
    return _over(t_quantile, p, df)
