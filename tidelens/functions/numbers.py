"""Effect sizes, classes and scalings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Z95 = 1.96


def percent_effect(beta: Column, periods: int = 1) -> Column:
    """Effect in percent of a coefficient on log(1+y), over so many periods."""
    return F.expm1(beta * periods) * 100


def interval(beta: Column, se: Column) -> tuple[Column, Column]:
    return beta - Z95 * se, beta + Z95 * se


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "†").otherwise("(n.s.)")


def sign_class(beta: Column, p: Column, level: float = 0.05) -> Column:
    return F.when(p >= level, "none").when(beta > 0, "up").otherwise("down")


def heterogeneity(i2: Column) -> Column:
    return F.when(i2 < 25, "low").when(i2 < 50, "moderate").when(i2 < 75, "substantial").otherwise("considerable")


def trend_class(relative_slope: Column, yearly: float = 0.05) -> Column:
    """Rising, Stable or Declining by the quarterly rate of a yearly change."""
    limit = (1 + yearly) ** 0.25 - 1
    return F.when(relative_slope > limit, "Rising").when(relative_slope < -limit, "Declining").otherwise("Stable")


def signed_log(x: Column) -> Column:
    return F.log1p(F.abs(F.coalesce(x, F.lit(0.0))))


def scaled(x: Column, low: float = 10.0, high: float = 50.0) -> Column:
    """x between its extremes over all rows, from low to high; the middle where all are equal. For small results only."""
    w = Window.partitionBy(F.lit(1))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return low + (high - low) * F.when(hi == lo, F.lit(0.5)).otherwise(F.try_divide(x - lo, hi - lo))


def bonferroni(p: Column, m: Column | int) -> Column:
    return F.least(p * m, F.lit(1.0))
