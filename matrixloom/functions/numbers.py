"""Numeric column builders."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Added before rounding, so that sums taken in another order don't fall on the other side of an exact half.
OFFSET = 1.234e-9


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded DOUBLE that is stable against the order of summation; minus zero is zero."""
    return F.round(c.cast("double") + F.lit(OFFSET), digits) + F.lit(0.0)


def number(c: Column) -> Column:
    """DOUBLE with NaN as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def log2p(c: Column) -> Column:
    return F.log2(c + F.lit(1.0))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def zscore(v: Column, by: list[str]) -> Column:
    """Population z-score within ``by``; 0 where there is no variance."""
    w = Window.partitionBy(*by)
    return F.coalesce(safe_div(v - F.avg(v).over(w), F.nullif(F.round(F.stddev_pop(v).over(w), 12), F.lit(0.0))), F.lit(0.0))


def minmax(v: Column, by: list[str]) -> Column:
    """Scaled to 0..1 within ``by``; 0 where all are equal."""
    w = Window.partitionBy(*by)
    return F.coalesce(safe_div(v - F.min(v).over(w), F.nullif(F.max(v).over(w) - F.min(v).over(w), F.lit(0.0))), F.lit(0.0))


def average_rank(v: Column, by: list[str]) -> Column:
    """Rank within ``by``, ties at their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count("*").over(Window.partitionBy(*by, v)) - 1) / 2.0


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side has no variance or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.var_pop(a) > 1e-18) & (F.var_pop(b) > 1e-18), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))
