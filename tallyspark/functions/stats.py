"""Aggregate columns with defined results for degenerate samples: null, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def correlation(x, y) -> Column:
    """Pearson correlation from one pass of moments, clamped to [-1, 1]; null for a constant sample."""
    x, y = col(x), col(y)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def slope(x, y) -> Column:
    """Least-squares slope of y on x; null for a constant x."""
    return F.try_divide(F.covar_samp(col(x), col(y)), F.var_samp(col(x)))


def adjusted_skewness(x) -> Column:
    """Adjusted Fisher-Pearson skewness, from Spark's population skewness; null under three values."""
    n = F.count(col(x)).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(col(x)) > 0), F.skewness(col(x)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(x) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(col(x)).cast("double")
    g2 = F.kurtosis(col(x))
    return F.when((n >= 4) & (F.stddev_pop(col(x)) > 0), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def average_rank(value: str, *by: str) -> Column:
    """One-based rank of ``value`` within ``by``; ties share the average of their ranks."""
    from pyspark.sql import Window

    low = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return low + (ties - 1) / 2.0
