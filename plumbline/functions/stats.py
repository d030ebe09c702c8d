"""Aggregate expressions for rates, correlations and sample moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole, zero where the whole is empty."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def true_positive_rate(y: Column, pred: Column, where: Column) -> Column:
    return ratio_or_zero(count_where(where & (y == 1) & (pred == 1)), count_where(where & (y == 1)))


def false_positive_rate(y: Column, pred: Column, where: Column) -> Column:
    return ratio_or_zero(count_where(where & (y == 0) & (pred == 1)), count_where(where & (y == 0)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null for a constant column (``corr`` raises there under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; zero below three values, null for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n < 3, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; zero below four values, null for a constant column."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n < 4, 0.0).otherwise(scale * ((n + 1) * g2 + 6))


def stability(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """1 for a normal shape, falling to 0 with skewness and excess kurtosis; 0.5 below four values."""
    penalty = (F.abs(skewness) + F.abs(kurtosis) / 3) / 4
    return F.when(n < 4, 0.5).when(penalty.isNotNull(), 1 - F.least(penalty, F.lit(1.0)))
